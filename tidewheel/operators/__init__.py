"""Panes, windows, replay of late data, details and retraction."""
