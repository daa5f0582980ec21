"""Column helpers: truth rules, exact decimals, text keys, fixed-width cells."""
