"""Scans of episode, annotation, relation, log and file tables; sinks and resume."""
