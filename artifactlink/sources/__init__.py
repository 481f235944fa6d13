"""Sources and sinks: containers, binary decoder, mapping files, reports."""
