"""Field contracts and extraction rules of the two kinds of source, as data and as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names, necessity and kinds of the fields that a source must give.
DIRECT_FIELDS = (
    ("external_id", True, "str"),
    ("url", True, "str"),
    ("title", True, "str"),
    ("price_raw", True, "str"),
    ("bedrooms_raw", True, "str"),
    ("property_type_raw", False, "str"),
    ("postcode_raw", False, "str"),
    ("deposit_raw", False, "str"),
    ("available_from_raw", False, "str"),
    ("min_tenancy_raw", False, "str"),
    ("furnished_raw", False, "str"),
    ("bills_included", False, "bool"),
    ("pets_allowed", False, "bool"),
    ("smokers_allowed", False, "bool"),
    ("student_friendly", False, "bool"),
    ("garden", False, "bool"),
    ("parking", False, "bool"),
    ("epc_rating", False, "str"),
    ("description", False, "str"),
    ("is_landlord_direct", False, "bool"),
)
AGENT_FIELDS = (
    ("external_id", True, "str"),
    ("url", True, "str"),
    ("title", True, "str"),
    ("price_raw", True, "str"),
    ("bedrooms_raw", True, "str"),
    ("bathrooms_raw", False, "str"),
    ("property_type_raw", False, "str"),
    ("postcode_raw", False, "str"),
    ("deposit_raw", False, "str"),
    ("available_from_raw", False, "str"),
    ("furnished_raw", False, "str"),
    ("epc_rating", False, "str"),
    ("is_landlord_direct", False, "bool"),
)

# Where the fields stand on a page. By page kind the items' selector and the rules of their fields.
TICKED = {"true_if": ".text-success", "false_if": ".text-danger"}
DIRECT_RULES = {
    "detail": (
        "body",
        {
            "title": {"sel": "h1"},
            "price_raw": {"label": "Rent PCM"},
            "deposit_raw": {"label": "Deposit"},
            "available_from_raw": {"label": "Available From"},
            "min_tenancy_raw": {"label": "Preferred Minimum Tenancy"},
            "furnished_raw": {"label": "Furnishing"},
            "epc_rating": {"label": "EPC Rating"},
            "bills_included": {"label": "Bills Included", **TICKED},
            "pets_allowed": {"label": "Pets Allowed", **TICKED},
            "smokers_allowed": {"label": "Smokers Allowed", **TICKED},
            "student_friendly": {"label": "Student Friendly", **TICKED},
            "garden": {"label": "Garden", **TICKED},
            "parking": {"label": "Parking", **TICKED},
            "bedrooms_raw": {"sel": "h1", "regex": r"^\s*(\d+\s*Bed|Studio|Room)"},
            "property_type_raw": {"sel": "h1", "regex": r"^(?:\d+\s*Bed\s+)?([A-Za-z ]+?)\s*,"},
            "postcode_raw": {"sel": "h1", "regex": r"([A-Za-z]{1,2}\d{1,2}[A-Za-z]?)\s*$"},
            "description": {"sel": "#descriptionText"},
            "is_landlord_direct": {"const": "true"},
        },
    ),
}
AGENT_RULES = {
    "search_list": (
        'div[data-testid^="propertyCard-vrt-"]',
        {"external_id": {"sel": "a[id^=prop]", "attr": "id", "regex": r"prop(\d+)"}, "address_raw": {"sel": "address"}},
    ),
    "detail": (
        "body",
        {
            "title": {"sel": 'h1[itemprop="streetAddress"]'},
            "price_raw": {"sel": '[data-testid="primaryPrice"]', "regex": r"(£\s*[\d,]+(?:\.\d{2})?\s*p(?:cm|w))"},
            "available_from_raw": {"label": "Let available date"},
            "deposit_raw": {"label": "Deposit", "regex": r"(£\s*[\d,]+)"},
            "furnished_raw": {"label": "Furnish type"},
            "property_type_raw": {"sel": '[data-testid="info-reel-PROPERTY_TYPE-text"]'},
            "bedrooms_raw": {"sel": '[data-testid="info-reel-BEDROOMS-text"]'},
            "bathrooms_raw": {"sel": '[data-testid="info-reel-BATHROOMS-text"]'},
            "postcode_raw": {"sel": 'h1[itemprop="streetAddress"]', "regex": r"([A-Za-z]{1,2}\d{1,2}[A-Za-z]?)\s*$"},
            "epc_rating": {"sel": '[data-testid="keyFeatures"]', "regex": r"EPC(?:\s+Rating)?\s*[=:]?\s*([A-G])\b"},
            "is_landlord_direct": {"const": "false"},
        },
    ),
}

CONTRACTS = {"direct": DIRECT_FIELDS, "agent": AGENT_FIELDS}
RULES = {"direct": DIRECT_RULES, "agent": AGENT_RULES}


def contracts(spark: SparkSession, known: dict[str, tuple] | None = None) -> DataFrame:
    """(source_key, field, required, kind) of every field that a source promises."""
    rows = [(source, *told) for source, fields in (known or CONTRACTS).items() for told in fields]
    return spark.createDataFrame(rows, "source_key string, field string, required boolean, kind string")


def rule_table(spark: SparkSession, known: dict[str, dict] | None = None) -> DataFrame:
    """The rule sets in the columns of ``rules.problems``: a row for each field of a source and page kind."""
    columns = ("path", "sel", "label", "const", "attr", "regex", "true_if", "false_if")
    rows = [
        (source, kind, "dom", None, item, field, *(rule.get(c) for c in columns))
        for source, kinds in (known or RULES).items() for kind, (item, fields) in kinds.items() for field, rule in fields.items()
    ]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ("source_key", "page_kind", "strategy", "root", "item", "field", *columns)))
