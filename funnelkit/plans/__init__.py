"""Rule sets, parameters, the composed mart, and the fixture query catalogue."""
