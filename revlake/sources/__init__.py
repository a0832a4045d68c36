"""Tables that a comparison reads and writes."""
