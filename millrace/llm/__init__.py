"""Operators for preparing training text: each in a module of its own, registered in ``queries``."""
