"""Cleaning, masking, splitting and filtering of texts as native column expressions. Null stays null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordweft.functions.classes import D, EDGE, NOT_AFTER_W, NOT_BEFORE_W, S
from wordweft.functions.columns import let

# What counts as personal data, in the order in which it is masked. A first character that can start a match is asked
# for before the word edge, and where it is a digit the edge is only "no word character before", which is much quicker to rule out.
_GAP = r"[-.\s\x1c-\x1f\x85\p{Z}]?"
_SPACE = r"[\s\x1c-\x1f\x85\p{Z}-]?"
PII_PATTERNS = {
    "EMAIL": rf"{EDGE}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}{EDGE}",
    "SSN": rf"(?={D}){NOT_AFTER_W}{D}{{3}}{_GAP}{D}{{2}}{_GAP}{D}{{4}}{NOT_BEFORE_W}",
    "CREDIT_CARD": rf"(?={D}){NOT_AFTER_W}(?:{D}[ -]*?){{13,19}}{EDGE}",
    "PHONE": rf"(?=[+(]|{D}){EDGE}(?:\+?{D}{{1,3}}{_SPACE})?(?:\(?{D}{{2,4}}\)?{_SPACE})?{D}{{3,4}}{_SPACE}{D}{{3,4}}{NOT_BEFORE_W}",
}
# What every text with a match holds.
_HINTS = {"EMAIL": "@", "SSN": D, "CREDIT_CARD": D, "PHONE": D}
# Tags and links that cleaning removes.
TAG_PATTERN = r"<[^>]*>"
URL_PATTERN = rf"https?://(www\.)?[-a-zA-Z0-9@:%._\+~#=]{{1,256}}\.[a-zA-Z0-9()]{{1,6}}{EDGE}([-a-zA-Z0-9()@:%_\+.~#?&/=]*)"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, f"^{S}+|{S}+$", "")


def collapse(text: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, f"{S}+", " "))


def _masking(name: str, pattern: str):
    return lambda t: F.when(t.rlike(_HINTS[name]), F.regexp_replace(t, pattern, f"[{name}]")).otherwise(t)


def mask_pii(text: Column) -> Column:
    """Personal data replaced by [EMAIL], [SSN], [CREDIT_CARD], [PHONE], each kind on what the one before has left."""
    for name, pattern in PII_PATTERNS.items():
        text = let(text, _masking(name, pattern))
    return text


def pii_findings(text: Column) -> Column:
    """Struct of counts by kind, each counted on what the kinds before have left, as masking would replace them."""
    names, patterns = list(PII_PATTERNS), list(PII_PATTERNS.values())

    def counted(t: Column, i: int, so_far: list[Column]) -> Column:
        counts = [*so_far, F.regexp_count(t, F.lit(patterns[i])).alias(names[i].lower())]
        return F.struct(*counts) if i + 1 == len(names) else let(_masking(names[i], patterns[i])(t), lambda left: counted(left, i + 1, counts))

    return let(text, lambda t: counted(t, 0, []))


def clean_text(text: Column, remove_urls: bool = True, remove_html: bool = True) -> Column:
    """Tags become a space, links vanish, white space collapses."""
    if remove_html:
        text = F.regexp_replace(text, TAG_PATTERN, " ")
    if remove_urls:
        text = F.regexp_replace(text, URL_PATTERN, "")
    return collapse(text)


def format_currency(amount: Column, symbol: str = "$") -> Column:
    """Symbol and amount with thousands separators and two digits (half to even on the binary value); what is no number stays as it is."""
    return F.concat(F.lit(symbol), F.coalesce(F.format_number(F.try_cast(amount, "double") if hasattr(F, "try_cast") else amount.try_cast("double"), 2), amount.cast("string")))


def split_sentences(text: Column) -> Column:
    """Sentences, cut at white space behind . ! or ?; blank ones dropped."""
    return F.filter(F.split(strip(text), rf"(?<=[.!?]){S}+"), lambda s: s.rlike(rf"[^\s\x1c-\x1f\x85\p{{Z}}]"))


def chunk_text(text: Column, n: int = 300) -> Column:
    """Words packed greedily into pieces of at most n characters, a longer word alone; pieces rejoin with one space. Empty gives none."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))
    grow = lambda s, w: F.when(
        (s["cur"] != "") & (F.length(s["cur"]) + 1 + F.length(w) > n), F.struct(F.concat(s["out"], F.array(s["cur"])).alias("out"), w.alias("cur"))
    ).otherwise(F.struct(s["out"].alias("out"), F.when(s["cur"] != "", F.concat(s["cur"], F.lit(" "), w)).otherwise(w).alias("cur")))
    packed = F.aggregate(F.split(text, " "), start, grow, lambda s: F.concat(s["out"], F.array(s["cur"])))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(packed)


def filter_stopwords(tokens: Column, stopwords: list[str]) -> Column:
    """Tokens whose lower-cased form is none of the stopwords, in order."""
    if not stopwords:
        return tokens
    held = F.array(*(F.lit(w) for w in sorted(stopwords)))
    return F.filter(tokens, lambda t: ~F.array_contains(held, F.lower(t)))


def bits_of_text(text: Column, num_bits: int) -> Column:
    """num_bits bits of the UTF-8 bytes, most significant first, cut or padded with zeros at the end."""
    size = num_bits // 8
    cut = F.substring(F.encode(text, "UTF-8"), 1, size)
    digits = F.rpad(F.hex(cut), size * 2, "0")
    nibbles = F.filter(F.split(digits, ""), lambda x: x != "")
    bits = F.array_join(F.transform(nibbles, lambda x: F.lpad(F.conv(x, 16, 2), 4, "0")), "")
    return F.transform(F.filter(F.split(bits, ""), lambda x: x != ""), lambda x: x.cast("int"))


def text_of_bits(bits: Column) -> Column:
    """The text of bits (rounded to 0 or 1), trailing zero bytes dropped, broken UTF-8 replaced."""
    joined = F.array_join(F.transform(bits, lambda b: F.round(b).cast("int").cast("string")), "")
    nibbles = F.transform(F.sequence(F.lit(0), (F.size(bits) / 4).cast("int") - 1), lambda i: F.conv(F.substring(joined, i * 4 + 1, F.lit(4)), 2, 16))
    whole = F.regexp_replace(F.array_join(nibbles, ""), "(?:00)+$", "")
    return F.when(F.size(bits) < 8, F.lit("")).otherwise(F.decode(F.unhex(F.when(F.length(whole) % 2 == 0, whole).otherwise(F.concat(whole, F.lit("0")))), "UTF-8"))
