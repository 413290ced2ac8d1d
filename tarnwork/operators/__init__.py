"""Relational operators of the linkage engine and of the event-log folds."""
