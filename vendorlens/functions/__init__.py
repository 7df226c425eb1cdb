"""Column-level functions: fiscal calendar, bands, grades, money format."""
from vendorlens.functions import calendar, scalar  # noqa: F401
