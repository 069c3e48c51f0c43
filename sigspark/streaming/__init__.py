"""Operators over unbounded streams; see ``stateful``."""
