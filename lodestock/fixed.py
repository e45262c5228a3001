"""What results are defined by. They are stated as they must be, not derived.

Word lists are compared with values in lower case without white space around them.
"""

import re

#: Sampling values that are no values, when a registry is pruned.
PRUNED_VALUES = ("en:undefined", "undefined", "not-applicable", "unknown", "none", "n/a", "na", "null", "nan", "", "-", "?")
#: Texts that are no values, when sampling values are derived from a column.
UNUSABLE_VALUES = ("", "null", "nan", "n/a", "unknown", "none", "na", "nil", "-", "?", "not specified", "not available", "undefined")
#: Texts that describe nothing.
EMPTY_DESCRIPTIONS = ("n/a", "unknown", "none", "null", "na", "", "not available", "not specified", "unspecified", "other", "-", "--", "n.a.")

#: Column names that mark metadata of a schema (whole names, any letter case).
SCHEMA_NAMES = ("schema_version", "rev", "revision", "version", "data_schema_version", "api_version")
#: Column names that mark audit times, if their values are epoch seconds.
AUDIT_TIME = r"(^|_)(last_modified|last_updated|created|updated|modified|entry_date)(_t|_at|_ts|_date|_time)?$"
EPOCH_FROM = 1e9

#: Column names that mark noise, by tag in the order they are tried; patterns are searched in the lower-case name.
NOISE_PATTERNS = {
    "noise_media_reference": "|".join(("_url", "url_", "image_", "_image", "img_", "_img", "photo", "thumbnail", "icon_", "_icon", "logo_", "_logo")),
    "noise_audit_trail": r"creator|editors?|checkers?|correctors?|informers?|photographers?",
    "noise_system_metadata": "|".join(("completeness", "data_quality", "states_tags", "ecoscore_data", "nutriments_estimated")),
    "noise_timestamp": r"^(created|updated|modified|last_edit|entry_dates?)",
}
#: Column names that mark identifiers, if their values are nearly unique: a word of the name, or the whole name.
ID_WORD = r"(^|_)(id|key|uuid|guid|sku|asin|isbn|code|barcode|ean|upc|gtin|item_number|product_code|catalog_number)($|_)"
ID_NAMES = ("id", "pk", "row_id", "item_id", "product_id", "code", "barcode", "sku")

#: Limits of the rules on column profiles.
ID_UNIQUENESS = 0.99
SPARSE_TAG, SPARSE_DROP = 0.4, 0.70
NEAR_CONSTANT = (0.05, 0.95)
LIST_ELEMENTS, LIST_ROWS = 100, 1000


def noise_tag(name: str) -> str | None:
    """The noise tag that a column's name alone gives it."""
    return next((tag for tag, pattern in NOISE_PATTERNS.items() if re.search(pattern, name.lower())), None)
