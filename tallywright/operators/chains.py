"""How each chain of stores writes its receipts: a table of formats, compiled to one expression.

The formats are those that extraction is told to follow; here a record is checked
against them, with the fields that break theirs by name. An empty field breaks none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywright.functions.text import text

#: Chain and the pattern of its names, in the order of trial (fixed values).
NAMES = (
    ("aeon", r"^TRUNG TÂM MUA SẮM AEON"), ("bhx_2024", r"^\d{4,5} BHX_[A-Z0-9]+_[A-Z0-9]+ - |^BÁCH HÓA XANH$"), ("bigc", r"^(?:SIEU THI )?(?:GO!|BIG C|TOPS MARKET)"), ("coopmart", r"^CO\.OPMART"), ("coopxtra", r"^CO-OPXTRA"),
    ("emart", r"^(?i:EMART)"), ("lotte", r"^(?i:LOTTE MART)"), ("satra", r"^SIÊU THỊ SÀI GÒN|^TRUNG TÂM (?:TM|THƯƠNG MẠI) SATRA"),
)
_MINUTE, _SECOND = r"\d{2}:\d{2}", r"\d{2}:\d{2}:\d{2}"
#: Chain, field and the form of the whole field (fixed values). No form is empty only: nothing is printed there.
FORMATS = (
    ("aeon", "pos_id", r"\d{2,3}"), ("aeon", "receipt_number", r"\d{7}"), ("aeon", "barcode", ""), ("aeon", "time", _MINUTE),
    ("bhx_2024", "pos_id", r"\d{6}"), ("bhx_2024", "receipt_number", r"OV\d{18}"), ("bhx_2024", "cashier", ""), ("bhx_2024", "barcode", ""),
    ("bigc", "pos_id", r"\d{3}"), ("bigc", "receipt_number", r"\d{4,}"), ("bigc", "cashier", r"\d+"), ("bigc", "barcode", r"\d+"), ("bigc", "time", _SECOND),
    ("coopmart", "pos_id", r"\d{1,4}"), ("coopmart", "receipt_number", r"\d+"), ("coopmart", "cashier", r"\d{8}-.+"), ("coopmart", "time", _SECOND),
    ("coopxtra", "pos_id", r"\d{1,4}"), ("coopxtra", "receipt_number", r"\d+"), ("coopxtra", "time", _SECOND),
    ("emart", "pos_id", r"\d{4}-\d{4}"), ("emart", "receipt_number", r"\d{4,5}"), ("emart", "cashier", r"\d{7}\(.+\)"), ("emart", "barcode", r"\d+"), ("emart", "time", _MINUTE),
    ("lotte", "pos_id", r"\d{4}-\d{4}"), ("lotte", "receipt_number", r"\d{18,24}|\d{4}-\d{4}"), ("lotte", "cashier", r"\d+\p{L}.*"), ("lotte", "barcode", r"\d+"), ("lotte", "time", _MINUTE),
    ("satra", "pos_id", r"SGT\d{2}"), ("satra", "receipt_number", r"24SGT.+"), ("satra", "barcode", r"\*24SGT\d{8}\*"), ("satra", "time", _MINUTE),
)
#: What some chains print before the name of a line (fixed value).
LINE_PREFIX = {"emart": r"^\d{2}\) VAT\d{2}\s+"}

Rules = tuple[tuple[str, str, str], ...]


def chain_of(name: Column, names: tuple[tuple[str, str], ...] = NAMES) -> Column:
    """The chain that a store's name shows; null if none."""
    found = F.lit(None).cast("string")
    for chain, pattern in reversed(names):
        found = F.when(text(name).rlike(pattern), chain).otherwise(found)
    return found


def broken_formats(type_: Column, field: dict[str, Column], formats: Rules = FORMATS, names: tuple[tuple[str, str], ...] = NAMES) -> Column:
    """The fields, in order, whose form is not that of the record's chain; ``name`` if it shows another chain or none.

    ``type_`` is a chain in lower case; a type that no rule knows breaks none, nor
    does a null or empty field. ``field`` has the columns by name; rules for others are passed over.
    """
    tests = []
    if "name" in field:
        tests.append(F.when(type_.isin(*[c for c, _ in names]) & (text(field["name"]) != "") & ~F.coalesce(chain_of(field["name"], names) == type_, F.lit(False)), "name"))
    for name in dict.fromkeys(f for _, f, _ in formats):
        if name in field:
            wrong = F.lit(False)
            for chain, of, form in formats:
                if of == name:
                    wrong = wrong | ((type_ == chain) & ~text(field[name]).rlike(f"^(?:{form})$"))
            tests.append(F.when((text(field[name]) != "") & F.coalesce(wrong, F.lit(False)), name))
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")


def line_name(type_: Column, name: Column) -> Column:
    """A line's name without what its chain prints before it."""
    out = text(name)
    for chain, pattern in LINE_PREFIX.items():
        out = F.when(type_ == chain, F.regexp_replace(text(name), pattern, "")).otherwise(out)
    return out
