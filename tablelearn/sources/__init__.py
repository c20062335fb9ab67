"""Sources: table input and the text-matrix readers."""
