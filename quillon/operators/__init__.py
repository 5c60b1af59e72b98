"""Search, roll-up, duplicates, trees and overlays over a catalogue."""
