"""Number-plate text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Plate formats, issuing codes, and characters that readers confuse.
STANDARD = r"^([A-Z]{2})(\d{1,2})([A-Z]{0,3})(\d{4})$"
BHARAT = r"^(\d{2})(BH)(\d{4})([A-Z]{1,2})$"
STATES = (
    "AN", "AP", "AR", "AS", "BR", "CG", "CH", "DD", "DL", "DN", "GA", "GJ", "HP", "HR", "JH", "JK", "KA", "KL", "LA", "LD",
    "MH", "ML", "MN", "MP", "MZ", "NL", "OD", "OR", "PB", "PY", "RJ", "SK", "TN", "TR", "TS", "UK", "UP", "WB",
)
TO_DIGIT = ("OQDUILJZASGTB", "0000111245678")
TO_LETTER = ("01245678", "OIZASGTB")
LOOKALIKE = {
    "O": "DQ", "D": "O", "Q": "O", "I": "TL", "T": "I", "L": "I", "S": "5", "B": "8", "G": "C", "C": "G", "U": "V", "V": "U",
    "M": "NHKA", "N": "M", "R": "P", "P": "R", "K": "XM", "X": "K", "H": "MA", "A": "HM",
}
MAX_REPAIRS = 3


def _state_repairs() -> dict[str, str]:
    """Two-letter codes that are one look-alike away from exactly one valid code."""
    near: dict[str, set[str]] = {}
    back = [(b, a) for a, bs in LOOKALIKE.items() for b in bs if b.isalpha()]
    for code in STATES:
        for i in (0, 1):
            for to, read in back:
                if code[i] == to:
                    near.setdefault(code[:i] + read + code[i + 1 :], set()).add(code)
    return {k: min(v) for k, v in near.items() if len(v) == 1 and k not in STATES}


def clean(raw: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(raw, F.lit(""))), "[^A-Z0-9]", "")


def digits(c: Column) -> Column:
    return F.translate(c, *TO_DIGIT)


def letters(c: Column) -> Column:
    return F.translate(c, *TO_LETTER)


def state_of(plate: Column) -> Column:
    code = F.regexp_extract(plate, STANDARD, 1)
    return F.when(code.isin(*STATES), code)


def valid(plate: Column) -> Column:
    return F.coalesce(state_of(plate).isNotNull() | plate.rlike(BHARAT), F.lit(False))


def slight(read: Column, repaired: Column) -> Column:
    """Whether a repair changes so little of what was read that it counts: three characters at most, or one more or less."""
    pairs = F.zip_with(F.split(read, ""), F.split(repaired, ""), lambda a, b: (a != b).cast("int"))
    changed = F.aggregate(pairs, F.lit(0), lambda s, x: s + x)
    return F.when(F.length(read) == F.length(repaired), changed <= MAX_REPAIRS).otherwise(F.abs(F.length(read) - F.length(repaired)) <= 1)


def repair_standard(text: Column) -> Column:
    """Letters for the state, then one or two digits, letters, and four digits; null if that has no middle digit."""
    n = F.length(text)
    middle = F.substring(text, F.lit(3), n - 6)
    # leading characters of the middle that can be digits, two at most
    lead = F.length(F.regexp_extract(digits(middle), r"^\d{0,2}", 0))
    out = F.concat(letters(F.substring(text, 1, 2)), digits(F.substring(middle, F.lit(1), lead)), letters(F.substring(middle, lead + 1, n)), digits(F.substring(text, n - 3, F.lit(4))))
    return F.when((n >= 9) & (n > 6) & (lead > 0), out)


def repair_bharat(text: Column) -> Column:
    series = letters(F.substring(text, 3, 2))
    out = F.concat(digits(F.substring(text, 1, 2)), series, digits(F.substring(text, 5, 4)), letters(F.substring(text, F.lit(9), F.length(text))))
    return F.when((F.length(text) >= 9) & (series == "BH"), out)


def _once(value: Column, use) -> Column:
    """use(value), with value evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalised(df: DataFrame, raw: str, out: str = "plate") -> DataFrame:
    """df with a valid plate number that the read is close to, or null: the text itself, else repaired as a standard plate, else
    as a Bharat-series one; each also with a state code that has exactly one look-alike.

    It is one expression whose steps are lambda variables: as columns of their own they would multiply when the optimiser moves a
    filter on the plate below them.
    """
    fixes = F.create_map(*[F.lit(x) for kv in sorted(_state_repairs().items()) for x in kv])

    def tried(t, c, state):
        known = state.isin(*STATES)
        other = F.when(state != "", F.concat(F.coalesce(F.when(known, state), F.try_element_at(fixes, state)), F.substring(c, F.lit(3), F.length(c))))
        return F.array(F.when((known | c.rlike(BHARAT)) & slight(t, c), c), _once(other, lambda r: F.when(slight(t, r), r)))

    def first(t):
        each = F.transform(F.array(t, repair_standard(t), repair_bharat(t)), lambda c: _once(F.regexp_extract(c, STANDARD, 1), lambda state: tried(t, c, state)))
        return F.when(F.length(t).between(8, 11), F.get(F.filter(F.flatten(each), lambda x: x.isNotNull()), F.lit(0)))

    return df.withColumn(out, _once(clean(F.col(raw)), first))


def display(plate: Column) -> Column:
    """Grouped as printed; other texts unchanged."""
    parts = F.filter(F.array(*[F.regexp_extract(plate, STANDARD, i) for i in (1, 2, 3, 4)]), lambda p: p != "")
    return F.when(plate.rlike(STANDARD), F.array_join(parts, " ")).otherwise(plate)


def plausible(text: Column) -> Column:
    return F.length(text).between(4, 13) & text.rlike(r"\d") & text.rlike("[A-Z]")


def plate_shaped(width: Column, height: Column, vehicle_width: Column) -> Column:
    return (width >= 12) & (height > 0) & (width / height).between(1.6, 7.0) & (width <= 0.5 * vehicle_width)


def overlap(truth: Column, guess: Column) -> Column:
    """Equal characters of the better of the left- and right-aligned match, as a share of the longer text."""
    def matches(a, b):
        same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 1).otherwise(0))
        return F.aggregate(same, F.lit(0), lambda s, x: s + x)

    best = F.greatest(matches(truth, guess), matches(F.reverse(truth), F.reverse(guess)))
    return F.when(F.greatest(F.length(truth), F.length(guess)) == 0, 0.0).otherwise(best / F.greatest(F.length(truth), F.length(guess)))


def holdout(plate: Column, share: float) -> Column:
    """True for a stable share of plates."""
    return F.conv(F.substring(F.sha1(plate), 1, 8), 16, 10).cast("double") / float(0xFFFFFFFF) < share
