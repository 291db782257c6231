"""Part of tabulon: streaming."""
