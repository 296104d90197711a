"""Text and address normalisation as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space, as a regular-expression class.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# Street words and their long forms.
STREET_WORDS = {
    "AV": "AVENUE",
    "AVE": "AVENUE",
    "ST": "STREET",
    "STR": "STREET",
    "BLVD": "BOULEVARD",
    "PKWY": "PARKWAY",
    "PL": "PLACE",
    "RD": "ROAD",
    "DR": "DRIVE",
    "TER": "TERRACE",
    "LN": "LANE",
    "CT": "COURT",
    "E": "EAST",
    "W": "WEST",
    "N": "NORTH",
    "S": "SOUTH",
    "BCH": "BEACH",
    "HTS": "HEIGHTS",
}

# Borough spellings.
BOROUGH_CODES = {
    "MANHATTAN": "MN",
    "BRONX": "BX",
    "BROOKLYN": "BK",
    "QUEENS": "QN",
    "STATEN ISLAND": "SI",
    "MN": "MN",
    "BX": "BX",
    "BK": "BK",
    "QN": "QN",
    "SI": "SI",
}

# Form of a listing line (borough, number, street, council, district, units).
LISTING_LINE = (
    r"^(MN|BX|BK|QN|SI)\s+(\d+[A-Z]?(?:-\d+[A-Z]?)?)\s+(.+?)\s+(\d+)\s+(\d+)\s+(\d+)\s*$"
)
# Words that mark a page header.
LISTING_HEADERS = [
    "BORO",
    "HOUSE",
    "NUMBER",
    "STREET",
    "COUNCIL",
    "COMMUNIT",
    "DISTRICT",
    "UNITS",
    "HEAT SENSOR",
    "NUMBER OF",
    "NUNMBER",
    "OF UNITS",
    "BOROUGH",
    "Y DISTRICT",
]
PAGE_COUNTER = r"^\d+ of \d+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def normalize_text(c: Column | str) -> Column:
    """Upper case, trimmed, single spaces; NULL becomes ''."""
    return collapse_spaces(F.upper(F.coalesce(_col(c), F.lit(""))))


def is_apartment(unit_type: Column | str, apartment: Column | str) -> Column:
    """A row about one apartment: of that unit type, with a value that is neither blank nor 'BLDG'."""
    value = normalize_text(apartment)
    return (normalize_text(unit_type) == "APARTMENT") & ~value.isin("", "BLDG")


def normalize_street(c: Column | str) -> Column:
    """'E. 136th St' -> 'EAST 136 STREET'."""
    flat = collapse_spaces(F.replace(F.upper(_col(c)), F.lit("."), F.lit(" ")))
    bare = F.regexp_replace(flat, r"(?<![\p{L}\p{N}_])(\p{Nd}+)(ST|ND|RD|TH)(?![\p{L}\p{N}_])", "$1")
    long_form = F.create_map(*[F.lit(x) for pair in STREET_WORDS.items() for x in pair])
    words = F.transform(
        F.split(bare, " "), lambda w: F.coalesce(F.try_element_at(long_form, w), w)
    )
    return F.array_join(words, " ")


def address_key(boro: Column, number: Column, street: Column) -> Column:
    return F.concat_ws("|", boro, F.upper(F.trim(number.cast("string"))), normalize_street(street))


def split_address(address: Column | str) -> tuple[Column, Column]:
    """House number and street, cut at the first space; no space means no street."""
    parts = F.split(_col(address), " ", 2)
    return F.element_at(parts, 1), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))


def owner_key(number: Column, street: Column, postcode: Column, company: Column) -> Column:
    """Business address when there is a street, else company name, else NULL."""
    street_text, company_text = normalize_text(street), normalize_text(company)
    address = F.concat(
        F.lit("ADDR:"),
        F.concat_ws("|", normalize_text(number), street_text, normalize_text(postcode)),
    )
    return F.coalesce(
        F.when(street_text != "", address),
        F.when(company_text != "", F.concat(F.lit("CORP:"), company_text)),
    )
