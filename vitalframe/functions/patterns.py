"""Value-shape patterns."""

from __future__ import annotations

# Name and expression of each shape, in listing order.
PATTERNS = (
    ("uuid", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),
    ("iso_datetime", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$"),
    ("iso_date", r"^\d{4}-\d{2}-\d{2}$"),
    ("email", r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
    ("url", r"^(https?|ftp|s3)://[^\s]+$"),
    ("ipv4", r"^(25[0-5]|2[0-4]\d|[01]?\d?\d)(\.(25[0-5]|2[0-4]\d|[01]?\d?\d)){3}$"),
    ("ipv6", r"^(?=.*:.*:)[0-9a-fA-F:]{3,}$"),
    ("ratio", r"^\d{1,4}:\d{1,4}$"),
    ("md5", r"^[a-f0-9]{32}$"),
    ("sha1", r"^[a-f0-9]{40}$"),
    ("sha256", r"^[a-f0-9]{64}$"),
    ("locale_code", r"^[a-z]{2}(_[A-Z]{2})?$"),
    ("country_code_iso2", r"^[A-Z]{2}$"),
    ("currency_code", r"^[A-Z]{3}$"),
    ("integer_id", r"^-?\d+$"),
    ("decimal", r"^-?\d+\.\d+$"),
    ("slug", r"^[a-z0-9]+(?:[-_][a-z0-9]+)+$"),
    ("prefixed_code", r"^[A-Z][A-Z0-9]{1,8}[-_]?[A-Z0-9]+$"),
    ("base64ish", r"^[A-Za-z0-9+/=]{16,}$"),
)
IDENTIFIER_PATTERNS = ("uuid", "integer_id", "md5", "sha1", "sha256", "prefixed_code", "base64ish")
MIN_CONFORMANCE = 0.6
