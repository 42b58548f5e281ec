"""Scalar functions as Column expressions: entropy, password strength, masking and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Common passwords, and bytes from which entropy is looked at.
COMMON_PASSWORDS = "password 123456 12345678 qwerty abc123 monkey master dragon 111111 baseball iloveyou trustno1 sunshine letmein football shadow michael login admin welcome passw0rd 1234567890 000000 access".split()
MIN_ENTROPY_LENGTH = 20
STRONG_PASSWORD = 6.0
SNIPPET_CHARS = 200


def shannon_entropy(s: Column) -> Column:
    """Bits a byte of the UTF-8 bytes of ``s``; 0 for the empty string."""
    n = F.octet_length(s).cast("double")

    def summed(counts: Column) -> Column:
        return F.aggregate(counts, F.lit(0.0), lambda a, c: a - c / n * F.log2(c / n))

    def of_bytes(pairs: Column) -> Column:
        return F.transform(F.array_sort(F.array_distinct(pairs)), lambda x: F.size(F.filter(pairs, lambda y: y == x)).cast("double"))

    def of_characters(characters: Column) -> Column:
        return F.transform(F.array_sort(F.array_distinct(characters)), lambda c: (F.length(s) - F.length(F.replace(s, c, F.lit("")))).cast("double"))

    pairs = F.regexp_extract_all(F.hex(F.encode(s, "utf-8")), F.lit(".."), F.lit(0))
    by_byte, by_character = F.transform(F.array(pairs), of_bytes)[0], of_characters(F.split(s, ""))  # the same where each character is a byte
    counts = F.when(F.octet_length(s) == F.length(s), by_character).otherwise(by_byte)
    return F.when(F.octet_length(s) == 0, F.lit(0.0)).otherwise(summed(counts))


def charset_entropy(s: Column, allowed: str) -> Column:
    """Entropy if all characters are in the class ``allowed``, else null."""
    return F.when(s.rlike(rf"^[{allowed}]*\z"), shannon_entropy(s))


def hex_entropy(s: Column) -> Column:
    return charset_entropy(s, "0-9a-fA-F")


def base64_entropy(s: Column) -> Column:
    return charset_entropy(s, r"A-Za-z0-9+/=_\-")


def alphanumeric_entropy(s: Column) -> Column:
    return charset_entropy(s, "A-Za-z0-9")


def passes_entropy(s: Column, threshold: Column) -> Column:
    """Short values always pass."""
    return (F.octet_length(s) < MIN_ENTROPY_LENGTH) | (shannon_entropy(s) >= threshold)


def password_strength(s: Column, entropy: Column | None = None) -> Column:
    """STRUCT: score, the four character classes, their number, whether it is a common word, entropy (if it isn't given)."""
    has = {"upper": s.rlike("[A-Z]"), "lower": s.rlike("[a-z]"), "digit": s.rlike("[0-9]"), "symbol": s.rlike(r"\p{Punct}")}
    classes = sum((c.cast("int") for c in has.values()), F.lit(0))
    common, n, h = F.lower(s).isin(COMMON_PASSWORDS), F.octet_length(s), shannon_entropy(s) if entropy is None else entropy
    add = lambda test, x: F.when(test, F.lit(x)).otherwise(F.lit(0.0))
    raw = h + add(classes >= 3, 1.0) + add(classes >= 4, 1.0) + add(n >= 12, 0.5) + add(n >= 20, 0.5) - add(common, 4.0) - add(n < 6, 2.0)
    return F.struct(F.greatest(raw, F.lit(0.0)).alias("score"), *(c.alias(f"has_{k}") for k, c in has.items()), classes.alias("classes"), common.alias("is_common"), h.alias("entropy"))


def is_strong_password(s: Column, entropy: Column | None = None) -> Column:
    return password_strength(s, entropy)["score"] >= STRONG_PASSWORD


def mask(s: Column) -> Column:
    """First and last two characters with stars between; values under six characters become all x."""
    n = F.char_length(s)
    return F.when(n < 6, F.repeat(F.lit("x"), n)).otherwise(F.concat(F.left(s, F.lit(2)), F.repeat(F.lit("*"), n - 4), F.right(s, F.lit(2))))


def sanitize(s: Column) -> Column:
    """Without control characters (tab stays), zero-width, bidirectional and invisible format characters."""
    return F.regexp_replace(s, r"[\x00-\x08\x0A-\x1F\x7F-\x{9F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{061C}\x{FEFF}]", "")


def unicode_trim(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+\z", "")


def snippet(s: Column) -> Column:
    """Sanitised and trimmed, at most 200 characters, then an ellipsis."""
    t = unicode_trim(sanitize(s))
    return F.when(F.char_length(t) > SNIPPET_CHARS, F.concat(F.left(t, F.lit(SNIPPET_CHARS)), F.lit("…"))).otherwise(t)


def text_of(content: Column) -> Column:
    """Bytes as text, each invalid sequence as U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))
