"""Sources and sinks: stores of collections, exporters, importers."""
