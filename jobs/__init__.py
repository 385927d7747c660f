"""Runnable jobs: a function over a session each, and a command line around it."""
