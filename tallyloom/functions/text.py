"""Text functions: natural order, exactness, escaping, privacy and naming, as column expressions."""

from __future__ import annotations

import re
import string
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest number of characters in one exchanged cell, and of digits in an integer (fixed values).
MAX_CELL_CHARACTERS = 32_767
MAX_INTEGER_DIGITS = 1_000
PATH_PLACEHOLDER = "[absolute-path-omitted]"
#: Code points that a cell can't hold: controls but TAB and LF, and noncharacters.
_BAD_CHARACTER = r"[\x00-\x08\x0B-\x1F\x{FDD0}-\x{FDEF}" + "".join(rf"\x{{{p:X}FFFE}}\x{{{p:X}FFFF}}" for p in range(17)) + "]"
_ESCAPE_TOKEN = r"_[xX][0-9A-Fa-f]{4}_"


def natural_key(text: Column) -> Column:
    """A sortable key: case-insensitive, with runs of digits compared as numbers.

    Parts are ``(kind, size, body)``: numbers come before text, and by length without leading
    zeros, then by digits.
    """
    parts = F.regexp_extract_all(F.lower(text), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def key(part: Column) -> Column:
        number = part.rlike("^[0-9]+$")
        body = F.when(number, F.regexp_replace(part, "^0+", "")).otherwise(part)
        return F.struct(F.when(number, 0).otherwise(1).alias("kind"), F.when(number, F.length(body)).otherwise(0).alias("size"), body.alias("body"))

    keyed = F.transform(parts, key)
    # A leading number sorts after nothing and before text: an empty text part stands before it.
    first = F.array(F.struct(F.lit(1).alias("kind"), F.lit(0).alias("size"), F.lit("").alias("body")))
    return F.when(text.rlike("^[0-9]"), F.concat(first, keyed)).otherwise(keyed)


def text_is_exact(text: Column) -> Column:
    """Whether a cell can hold the text unchanged, whatever its length."""
    return ~text.rlike(f"{_BAD_CHARACTER}|{_ESCAPE_TOKEN}")


def cell_text_is_exact(text: Column) -> Column:
    return (F.length(text) <= MAX_CELL_CHARACTERS) & text_is_exact(text)


_ESCAPED = re.compile(
    "~|_(?=[xX][0-9A-Fa-f]{4}_)|[\x00-\x08\x0b-\x1f\ud800-\udfff\ufdd0-\ufdef" + "".join(chr(p << 16 | c) for p in range(17) for c in (0xFFFE, 0xFFFF)) + "]"
)


def _escape(text: str) -> str:
    """Tildes doubled; unholdable characters and the first underscore of a token as ~uXXXXXX;"""
    return _ESCAPED.sub(lambda m: "~~" if m[0] == "~" else f"~u{ord(m[0]):06X};", text)


def audit_display(text: Column) -> Column:
    """A reversible form of the text that a cell can hold; texts that need nothing skip Python."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(_escape, na_action="ignore")

    return F.when(text.contains("~") | ~text_is_exact(text), run(text)).otherwise(text)


def audit_restore(shown: Column) -> Column:
    """The text that ``audit_display`` made the shown form from."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        back = lambda m: "~" if m[0] == "~~" else chr(int(m[1], 16))
        return values.map(lambda v: re.sub(r"~~|~u([0-9A-F]{6});", back, v), na_action="ignore")

    return F.when(shown.contains("~"), run(shown)).otherwise(shown)


def preview_display(text: Column) -> Column:
    """Format and control characters as \\uXXXX, then as ``audit_display``."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def shown(v: str) -> str:
            return "".join(f"\\u{ord(c):04X}" if unicodedata.category(c) in ("Cc", "Cf", "Zl", "Zp") else c for c in v)

        return values.map(shown, na_action="ignore")

    return audit_display(F.when(text.rlike(r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]"), run(text)).otherwise(text))


def _only(text: Column, allowed: str) -> Column:
    """Whether a text isn't empty and has characters of ``allowed`` alone."""
    return (text != "") & (F.translate(text, allowed, "") == "")


def _tokens(text: Column) -> Column:
    """What stands between white space, quotes and angle brackets: no path goes over them."""
    return F.filter(F.split(text, "[\\p{IsWhite_Space}\\x1C-\\x1F'\"<>]+"), lambda t: t != "")


def _schemes(text: Column) -> Column:
    """What looks like the scheme of an address, in lower case, with its colon and slashes.

    Read backwards from each colon, so that long texts take no longer than their length.
    """
    pieces = F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), ":")
    n = F.size(pieces) - 1

    def scheme(i: Column) -> Column:
        name = F.reverse(F.regexp_extract(F.reverse(F.get(pieces, i - 1)), "^[a-z0-9+.-]*", 0))
        return F.concat(name, F.when(F.get(pieces, i).startswith("//"), F.lit("://")).otherwise(F.lit(":")))

    named = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), scheme)).otherwise(F.array().cast("array<string>"))
    return F.filter(named, lambda s: F.contains(F.lit(string.ascii_lowercase), F.substring(s, 1, 1)) & ~s.startswith(":"))


_NAME = string.ascii_letters + string.digits


def _ends_apart(piece: Column, joining: str) -> Column:
    """Whether a piece's last character isn't one of ``joining``: what follows it doesn't go on from a name."""
    return ~F.contains(F.lit(joining), F.substring(piece, -1, 1))


def _at_cuts(token: Column, mark: str, test) -> Column:
    """Whether ``test(before, after, i, n)`` holds at any of the token's ``n`` cuts at ``mark``; ``before`` and
    ``after`` are the pieces on both sides, and a piece between two marks that touch is empty."""
    pieces = F.split(token, mark)
    n = F.size(pieces) - 1
    return (n > 0) & F.exists(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: test(F.get(pieces, i - 1), F.get(pieces, i), i, n))


def _begins(before: Column, i: Column, joining: str) -> Column:
    """Whether a mark begins something: at the token's start, or after a character that joins nothing to it."""
    return F.when(before == "", i == 1).otherwise(_ends_apart(before, joining))


def _token_is_local(token: Column) -> Column:
    """A drive letter with something after its colon, a host and a share behind two backslashes, or a name that
    starts at a root; a slash roots a name only before a web address, which goes to the token's end."""
    follows = lambda after, i, n: (after != "") | (i < n)

    def drive(before: Column, after: Column, i: Column, n: Column) -> Column:
        letter = F.contains(F.lit(string.ascii_letters), F.substring(before, -1, 1)) & (before != "")
        alone = (F.length(before) == 1) & (i > 0) | (F.length(before) > 1) & ~F.contains(F.lit(_NAME), F.substring(before, -2, 1))
        return letter & alone & follows(after, i, n)

    def root(before: Column, after: Column, i: Column, n: Column) -> Column:
        return _begins(before, i, _NAME) & (after != "")

    def slash(before: Column, after: Column, i: Column, n: Column) -> Column:
        return _begins(before, i, _NAME + "_:") & follows(after, i, n)

    pieces = F.split(token, r"\\")
    piece = lambda i: F.get(pieces, i)

    def share(before: Column, after: Column, i: Column, n: Column) -> Column:
        """``after`` is a host: two marks stand before it, no third one, and a mark and more after it."""
        two = (i >= 2) & (before == "") & ((i == 2) | (piece(i - 2) != ""))
        return two & (after != "") & (i < n) & ((piece(i + 1) != "") | (i + 1 < n))

    web = F.regexp_instr(token, F.lit("(?is)(?:^|[^a-z0-9+.-])https?://."))
    own = F.when(web > 0, F.concat(F.substring(token, F.lit(1), web), F.lit("w"))).otherwise(token)  # a word stands for the address
    return _at_cuts(token, ":", drive) | _at_cuts(token, r"\\", share) | _at_cuts(token, r"\\", root) | _at_cuts(own, "/", slash)


def has_local_path(text: Column) -> Column:
    """Whether a text holds a drive, UNC or rooted path, a file: or other non-web URI, or a POSIX
    absolute path outside a web address."""
    elsewhere = F.exists(_schemes(text), lambda s: s.isin("file:", "file://") | (s.endswith("//") & ~s.isin("http://", "https://")))
    return elsewhere | F.exists(_tokens(text), _token_is_local)


def scrub_local_path(text: Column) -> Column:
    return F.when(has_local_path(text), PATH_PLACEHOLDER).otherwise(text)


def has_uri_reference(text: Column) -> Column:
    return F.size(_schemes(text)) > 0


def _names_a_place(source: Column) -> Column:
    """``table:row:3``, ``table:row:3:column:2``, ``sheet:1:cell:AB12`` and ``canonical:name``."""
    part = F.split(source, ":")
    at = lambda i: F.get(part, i)
    number = lambda i: _only(at(i), string.digits)
    table = (at(0) != "") & (F.translate(at(0), "/\\?#\r\n", "") == at(0)) & (at(1) == "row") & number(2)
    letters = F.rtrim(at(3), F.lit(string.digits))
    digits = F.substr(at(3), F.length(letters) + 1)
    cell = _only(letters, string.ascii_uppercase) & (F.length(letters) <= 3) & _only(digits, string.digits) & ~digits.startswith("0")
    return F.coalesce(
        F.when(F.size(part) == 2, (at(0) == "canonical") & _only(at(1), string.ascii_letters + string.digits + "_.-"))
        .when(F.size(part) == 3, table)
        .when((F.size(part) == 4) & (at(0) == "sheet") & (at(2) == "cell"), number(1) & cell)
        .when(F.size(part) == 5, table & (at(3) == "column") & number(4)),
        F.lit(False),
    )


def locator_is_unsafe(source: Column) -> Column:
    """Whether a metadata locator is other than a row, cell or canonical one and may lead outside."""
    return has_local_path(source) | source.rlike(r"\p{Cntrl}") | (~_names_a_place(source) & has_uri_reference(source))


def issue_code_is_valid(code: Column) -> Column:
    """Up to 64 capitals, digits and underscores, a capital first."""
    first = F.substring(code, 1, 1)
    return (F.length(code) <= 64) & _only(first, string.ascii_uppercase) & _only(code, string.ascii_uppercase + string.digits + "_")


def integer_within_bound(digits: Column) -> Column:
    """Whether an integer lexeme has at most a thousand digits, leading zeros aside."""
    return F.length(F.regexp_replace(digits, r"^[+\-]?0*", "")) <= MAX_INTEGER_DIGITS


def normal_header(header: Column) -> Column:
    """Trimmed, lower case, with runs of white space and hyphens as one underscore."""
    return F.regexp_replace(F.lower(F.regexp_replace(header, r"^\s+|\s+$", "")), r"[\s\-]+", "_")


def extension(path: Column) -> Column:
    """The last extension with its dot, in lower case; empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))


def normal_extension(token: str) -> str:
    """An extension as given by a user, dotted and lower case."""
    token = token.strip().lower()
    return token if token.startswith(".") else f".{token}"


def percent_escape(text: Column) -> Column:
    """Every byte that isn't an ASCII letter or digit as %XX."""
    encoded = F.url_encode(text)
    for raw, code in (("+", "%20"), ("-", "%2D"), ("_", "%5F"), (".", "%2E"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(raw), F.lit(code))
    return encoded


def matrix_base(compound: Column, detector: Column, channel: Column) -> Column:
    """Column name of a compound's area, qualified where a detector or channel is known."""
    part = lambda name, value: F.concat(F.lit(f"[{name}="), percent_escape(F.coalesce(value, F.lit(""))), F.lit("]"))
    plain = detector.isNull() & channel.isNull()
    qualified = F.concat(F.lit("q"), part("compound", compound), part("detector", detector), part("channel", channel), F.lit("_area"))
    return F.when(plain, F.concat(compound, F.lit("_area"))).otherwise(qualified)


def is_number_text(text: Column) -> Column:
    return text.rlike(r"^[+\-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+\-]?[0-9]+)?$")


def formula_safe(text: Column) -> Column:
    """A leading quote before texts that a spreadsheet would run; numbers stay."""
    risky = F.substring(text, 1, 1).isin("=", "+", "-", "@") & ~is_number_text(text)
    return F.when(risky, F.concat(F.lit("'"), text)).otherwise(text)


def is_formula_like(text: Column) -> Column:
    return F.substring(text, 1, 1).isin("=", "+", "-", "@")


def public_reference(relative_path: Column, private: Column, sha256: Column, input_order: Column) -> Column:
    """What may be shown of a source: its relative path, or an alias of its hash or place."""
    alias = F.coalesce(F.concat(F.lit("source-"), sha256), F.format_string("source-input-%06d", input_order + 1))
    return F.when(private, alias).otherwise(relative_path)


def hash_name(prefix: str, sha256: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(sha256, 1, 16))


def known_name(name: Column) -> Column:
    """A compound name; blank names and the word "unknown" are none."""
    return F.when((F.trim(name) != "") & (F.lower(name) != "unknown"), name)


def bounded_details(details: Column, most: int = 32, key_length: int = 64, value_length: int = 512) -> Column:
    """At most ``most`` ``(k, v)`` details, with short keys and short, path-free values."""
    return F.transform(
        F.slice(details, 1, most),
        lambda d: F.struct(F.substring(d["k"], 1, key_length).alias("k"), F.substring(scrub_local_path(d["v"]), 1, value_length).alias("v")),
    )


def dataset_names(requested: list[str], longest: int = 31) -> list[str]:
    """Names for datasets: normalised, without forbidden characters, short and unique without case."""
    used, out = set(), []
    for name in requested:
        base = re.sub(r"[\[\]:*?/\\\x00-\x1f]", "_", unicodedata.normalize("NFC", name)).strip("'")[:longest] or "Sheet"
        if base.lower() == "history":
            base = "History_"
        candidate, k = base, 2
        while candidate.lower() in used:
            suffix = f"_{k}"
            candidate, k = base[: longest - len(suffix)] + suffix, k + 1
        used.add(candidate.lower())
        out.append(candidate)
    return out
