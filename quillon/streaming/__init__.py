"""Change journals folded into a catalogue."""
