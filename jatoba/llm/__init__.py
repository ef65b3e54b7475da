"""Operators for preparing training text at corpus scale.  Nothing outside imports this package."""
