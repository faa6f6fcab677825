"""Query bindings over the test tables."""
