"""Physical strategies for ordered work that must survive hot keys."""
