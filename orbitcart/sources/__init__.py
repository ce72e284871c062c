"""Sources and sinks: the canonical retail tables over the test data, file readers/writers."""
