"""Part of folioscope."""
