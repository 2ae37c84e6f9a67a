"""End-to-end jobs and the registered query catalogue.

The catalogue is loaded first so that the query families can register
themselves whatever module a caller imports.
"""

from . import catalog  # noqa: F401
