"""Part of tabulon: functions."""
