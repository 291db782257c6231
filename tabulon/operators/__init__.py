"""Part of tabulon: operators."""
