"""Token patterns of drawing text, written for Java's and Python's regular expressions alike.

Fixed values: the patterns and symbols must equal the grammar's. Use with the flags IGNORECASE | UNICODE (java() adds them).
"""

NUMBER = r"(?:\d+(?:[.,]\d*)?|[.,]\d+)"
NOMINAL = rf"\(?{NUMBER}(?:°|DEG|MM|CM|IN|FT|\"|')?\)?"
SIGN = r"(?:±|\+/-|[+\-])"
SIGNED = rf"{SIGN}\s*{NUMBER}"
TOLERANCE = rf"{SIGNED}(?:\s*/\s*[+\-]?\s*{NUMBER})?"
QUANTITY = r"\d+\s*[X×]"
FEATURE = r"(?:Ø|⌀|DIA\.?|R|SR)"
FEATURE_WITHIN = r"(?:Ø|⌀|\bDIA\.?|\bSR(?=\s*[.,]?\d)|\bR(?=\s*[.,]?\d))"
QUALIFIER = r"(?:BOTH\s+SIDES|THRU|THROUGH|TYP(?:ICAL)?|REF(?:ERENCE)?|MAX(?:IMUM)?|MIN(?:IMUM)?|EQ\s+SP|PLACES?)"
UNIT = r"(?:MM|CM|IN|FT|DEG|°|\"|')"
NOT_DIMENSION = r"\b(?:SECTION|SCALE|DRAWING|DWG|PAGE|PART|SHEET|ZONE|REV|REVISION|NOTE)\b"
GDT_FEATURES = "⌖⏥⏊∥⌭⌒⌓○⌀"
GDT_MODIFIERS = "ⓂⓁⓈ"
GDT_WORDS = r"\b(?:ANGULARITY|CIRCULARITY|CONCENTRICITY|CYLINDRICITY|DATUM|FLATNESS|PARALLELISM|PERPENDICULARITY|POSITION|PROFILE|RUNOUT|STRAIGHTNESS|SYMMETRY|TOTAL\s+RUNOUT)\b"
GDT_MODIFIER_WORDS = r"\b(?:LMC|MMC|RFS)\b"
DECIMAL = r"(?:\d+[.,]\d*|[.,]\d+)"
GDT_TOLERANCE = rf"(?:Ø|⌀|DIA\.?)?\s*{DECIMAL}(?:\s*{SIGN}\s*{NUMBER})?\s*[ⓂⓁⓈ]?"
DATUM = r"[A-Z](?:\s*[ⓂⓁⓈ])?"

# The classifier's own patterns.
CLASS_GDT_WORDS = r"\b(?:ANGULARITY|CIRCULARITY|CONCENTRICITY|CYLINDRICITY|DATUM|FLATNESS|MMC|LMC|PARALLELISM|PERPENDICULARITY|POSITION|PROFILE|RUNOUT|STRAIGHTNESS|SYMMETRY|TOTAL\s+RUNOUT)\b"
CLASS_REVISION = r"\b(?:REV|REVISION|ECN|ECO|CHANGE\s+NOTICE)\b"
CLASS_NOTE = r"\b(?:GENERAL\s+NOTES?|NOTES?|UNLESS\s+OTHERWISE|DO\s+NOT|TYP(?:ICAL)?|DEBURR|BREAK\s+(?:ALL\s+)?EDGES|REMOVE\s+BURRS|MATERIAL|FINISH|WELD|SURFACE|HARDNESS|TORQUE|CLEAN)\b"
CLASS_NOT_DIMENSION = r"\b(?:DRAWING|DWG|PAGE|PART|SCALE|SHEET|ZONE)\b"
CLASS_DIMENSION = r"(?:^|\s)(?:\d+\s*[xX]\s*)?(?:R|SR|Ø|⌀|DIA\.?|M)?\s*(?:\d+(?:[.,]\d+)?|[.,]\d+)(?:\s*/\s*\d+)?\s*(?:MM|CM|M|IN|FT|°|DEG|\"|')?(?:\s*(?:±|\+/-|\+\s*\d|[-+]\s*\d|MAX\b|MIN\b|REF\b|TYP\b|THRU\b|EQ\s+SP))?"
CLASS_REVISION_CELL = r"(?:[A-Z]{1,2}|\d{1,3}|\d{1,2}[-/.]\d{1,2}(?:[-/.]\d{2,4})?)"


def java(pattern: str, whole: bool = False) -> str:
    """The pattern with case folding and Unicode classes; whole: for the whole text."""
    return "(?iuU)" + (rf"^(?:{pattern})$" if whole else pattern)
