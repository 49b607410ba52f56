"""Operators that prepare training text. Nothing outside this folder imports it, but for the guarded import in __spark_entry__.py."""
