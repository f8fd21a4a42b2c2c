"""Text columns that leave the system."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that carry secrets.
SECRET = "password|passwd|pwd|pass|token|key|secret|auth|apikey|api_key|access_token"


def redact(url: Column) -> Column:
    """URLs with the password and the values of secret query parameters as `***`; other texts unchanged."""
    out = F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#@:]*):[^/?#@]*@", "$1:***@")
    out = F.regexp_replace(out, rf"(?i)([?&](?:{SECRET})=)[^&#]*", "$1***")
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), out).otherwise(url)
