"""Sources and sinks: declared input schemas, the test-table adapter, readers and writers."""
