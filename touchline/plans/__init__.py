"""Query plans: the test-data adapter and the registered queries."""
