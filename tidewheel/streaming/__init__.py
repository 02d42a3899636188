"""The window operator as a stateful processor."""
