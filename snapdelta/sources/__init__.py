"""Where snapshots come from."""
