"""Registered queries against their SQL, and the driver contract."""

import os
import subprocess
import sys
import textwrap

import pytest
from oracle import compare, connect

from tapeworks import catalog

catalog.load()
CORE = ("dollar_bars", "split_bars", "split_bars_scaled", "hybrid_clock_buckets", "resync", "vpin_zscore", "vpin_time_decay", "absorption", "sweep", "large_print",
        "ofi_pulse", "radar_alerts", "parse_trades", "parse_book", "markout", "exit_rules", "macro_regime", "leader_shock", "triple_barrier", "purged_kfold",
        "book_validity", "book_at", "position_ledger", "sector_heat", "spoof_trust", "maker_fill_audit", "alert_sink", "pipeline_metrics", "position_arbitration", "click_audit", "rtt_p99", "ema_fold", "quarantine_stash", "stream_radar", "state_seed")
NAMES = sorted(catalog.ORACLES) if os.environ.get("ALL_QUERIES") else CORE


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, sf, con, name):
    verdict = compare(catalog.QUERIES[name](spark, sf), con, catalog.ORACLES[name])
    assert verdict.startswith("ok"), verdict


def test_entry_runs(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert {"symbol", "end_us", "direction", "z_score"} <= set(df.columns)
    assert df.count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_training_data_folder():
    """The entry module imports, and keeps the other queries, where ``tapeworks/llm`` is absent."""
    code = textwrap.dedent("""
        import importlib.abc, sys

        class Hidden(importlib.abc.MetaPathFinder):
            def find_spec(self, name, path=None, target=None):
                if name.startswith("tapeworks.llm."):
                    raise ModuleNotFoundError(name, name=name)

        import importlib.util
        seen = importlib.util.find_spec
        importlib.util.find_spec = lambda name, package=None: None if name.startswith("tapeworks.llm") else seen(name, package)
        sys.meta_path.insert(0, Hidden())
        import __spark_entry__ as e
        assert "dollar_bars" in e.queries() and "pipeline" not in e.queries() and not any(q.startswith("op1_") for q in e.queries())
    """)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_empty_tables(spark, tmp_path):
    """Registered queries run on tables without rows: all of them with ALL_QUERIES, else those over ordered scans."""
    raw = spark.read.parquet
    for name in os.listdir("/root/testdata/sf0.001"):
        if name.endswith(".parquet"):
            raw(f"/root/testdata/sf0.001/{name}").limit(0).write.parquet(f"{tmp_path}/{name}")
    failed = {}
    for name in [q for q in catalog.QUERIES if q in NAMES]:
        try:
            catalog.QUERIES[name](spark, str(tmp_path)).collect()
        except Exception as e:  # noqa: BLE001  all failures are told at once
            failed[name] = str(e).splitlines()[0][:200]
    assert not failed, failed
