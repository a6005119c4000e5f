"""Tables and indexes that follow a growing folder."""
