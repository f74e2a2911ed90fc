"""Scalar text columns: rendering, sanitizing, times, names, ids, byte clipping."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---- fixed values -------------------------------------------------------------------------------
TAG_BYTES = 96            # a tag longer than this is not a tag
CLIP_BYTES = 96 * 1024    # request text budget
SAMPLE_BYTES = 16 * 1024  # per-side transcript sample
# Windows-1252 code points of the bytes 0x80..0x9F; undefined bytes stand for themselves.
CP1252_C1 = (
    "€\u0081‚ƒ„…†‡ˆ‰Š‹Œ\u008dŽ\u008f"
    "\u0090‘’“”•–—˜™š›œ\u009džŸ"
)
# -------------------------------------------------------------------------------------------------

_PAD = r"[\x00-\x20]*"
_ASS = r"\{\\[^}]*\}"
_SIMPLE = rf"<{_PAD}(?:/?[ibuIBU]|/(?i:font)){_PAD}>"
_ATTR = (
    r"[ \t]*(?:"
    r"(?i:color)(?:\t[ \t]*)?=[ \t]*(?:\"[#0-9A-Za-z]+\"|'[#0-9A-Za-z]+'|[#0-9A-Za-z]+(?=[\x00-\x20]*>|[ \t]))"
    r"|(?i:face)(?:\t[ \t]*)?=[ \t]*(?:\"[0-9A-Za-z _\x{80}-\x{10FFFF}-]+\"|'[0-9A-Za-z _\x{80}-\x{10FFFF}-]+'"
    r"|[0-9A-Za-z_\x{80}-\x{10FFFF}-]+(?=[\x00-\x20]*>|[ \t]))"
    r"|(?i:size)(?:\t[ \t]*)?=[ \t]*(?:\"[0-9]+\"|'[0-9]+'|[0-9]+(?=[\x00-\x20]*>|[ \t]))"
    r")"
)
_FONT = rf"<{_PAD}(?i:font)[ \t](?:{_ATTR})+[ \t]*{_PAD}>"
_TOKEN = rf"(?s){_ASS}|(?=<[^>]{{0,{TAG_BYTES - 1}}}>)(?:{_SIMPLE}|{_FONT})|[^{{<]+|[{{<]"


def _lit(pattern: str) -> Column:
    return F.lit(pattern)


def markup_tokens(text: Column) -> Column:
    """Caption text cut into override blocks, accepted tags and plain stretches."""
    return F.regexp_extract_all(text, _lit(_TOKEN), F.lit(0))


def _is_font(token: Column) -> Column:
    return token.rlike(rf"^<{_PAD}(?i:font)[ \t]") & token.endswith(">") & (F.octet_length(token) <= TAG_BYTES + 1)


def _is_simple(token: Column) -> Column:
    return token.rlike(rf"^{_SIMPLE}$")


def _is_ass(token: Column) -> Column:
    return token.startswith("{\\") & token.endswith("}")


def _escape(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "<br>")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def _font_attribute(attr: Column) -> Column:
    key = F.lower(F.regexp_extract(attr, r"^[ \t]*([A-Za-z]+)", 1))
    value = F.regexp_replace(F.regexp_extract(attr, r"(?s)=[ \t]*(.*)$", 1), "^[\"']|[\"']$", "")
    return F.concat(F.lit(" "), key, F.lit('="'), value, F.lit('"'))


def sanitize_markup(text: Column) -> Column:
    """Caption text as safe markup: whitelisted tags kept, override blocks dropped, the rest escaped."""
    def piece(token: Column) -> Column:
        attrs = F.transform(F.regexp_extract_all(token, _lit(_ATTR), F.lit(0)), _font_attribute)
        return (
            F.when(_is_ass(token), F.lit(""))
            .when(_is_simple(token), F.regexp_replace(token, r"[\x00-\x20]", ""))
            .when(_is_font(token), F.concat(F.lit("<font"), F.array_join(attrs, ""), F.lit(">")))
            .otherwise(_escape(token))
        )
    pieces = F.array_join(F.transform(markup_tokens(text), piece), "")
    return F.when(text.rlike("[<{]"), pieces).otherwise(_escape(text))


def markup_verdicts(text: Column) -> Column:
    """Every ``<...>`` of a caption as (tag, verdict): kept when whitelisted, escaped otherwise."""
    tags = F.regexp_extract_all(text, _lit(r"<[^<>]*>"), F.lit(0))
    return F.transform(tags, lambda t: F.struct(
        F.lower(F.regexp_extract(t, rf"^<{_PAD}(/?[A-Za-z0-9!]*)", 1)).alias("tag"),
        F.when(t.rlike(rf"^(?:{_SIMPLE}|{_FONT})$") & (F.octet_length(t) <= TAG_BYTES + 1), F.lit("kept"))
        .otherwise(F.lit("escaped")).alias("verdict")))


def render_line(text: Column) -> Column:
    """Caption text as the one line that all matching reads: markup consumed, breaks as spaces."""
    plain = F.array_join(F.filter(
        markup_tokens(text), lambda t: ~(_is_ass(t) | _is_simple(t) | _is_font(t))), "")
    rendered = F.btrim(F.regexp_replace(plain, r"[ \t\n\f\r]+", " "))
    # Most captions are plain; only the others pay for the tokenizer.
    return F.when(text.rlike(r"[<{\t\n\f\r]|  "), rendered).otherwise(F.btrim(text))


def to_ms(seconds: Column) -> Column:
    return F.floor(seconds * 1000 + F.lit(0.5)).cast("bigint")


def format_time(ms: Column, with_ms: bool = False) -> Column:
    """``M:SS`` below an hour, ``H:MM:SS`` from there, optionally ``.mmm``."""
    hours = F.floor(ms / 3600000).cast("bigint")
    minutes = F.floor(ms / 60000).cast("bigint") % 60
    seconds = F.floor(ms / 1000).cast("bigint") % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    out = F.when(hours > 0, F.concat_ws(":", hours.cast("string"), two(minutes), two(seconds))).otherwise(
        F.concat_ws(":", minutes.cast("string"), two(seconds)))
    if with_ms:
        out = F.concat(out, F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))
    return out


def numbered_line(cue_no: Column, start_ms: Column, line: Column) -> Column:
    return F.concat(F.lit("#"), cue_no.cast("string"), F.lit(" ["), format_time(start_ms, True), F.lit("] "), line)


def sha_head(text: Column) -> Column:
    """Default content hash: the first eight bytes of SHA-256 as sixteen hex digits."""
    return F.left(F.sha2(text, 256), F.lit(16))


@F.pandas_udf(StringType())
def blake_head(text: pd.Series) -> pd.Series:
    """Content hash compatible with BLAKE2b-256 names, for callers who need them byte for byte."""
    return text.map(lambda t: None if t is None else hashlib.blake2b(t.encode(), digest_size=32).hexdigest()[:16])


def content_id(salt: str, *parts: Column, hash_fn=sha_head) -> Column:
    return hash_fn(F.concat(F.lit(salt), *parts))


def pair_id(tag: str, a: Column, b: Column, hash_fn=sha_head) -> Column:
    return hash_fn(F.concat(F.lit(tag), F.array_join(F.array_sort(F.array(a, b)), "")))


def parse_id(text: Column) -> Column:
    """Sixteen hex digits as a lower-case id; anything else, and the zero id, is NULL."""
    ok = text.rlike("^[0-9A-Fa-f]{16}$") & (text != F.lit("0" * 16))
    return F.when(ok, F.lower(text))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_name(path: Column) -> Column:
    return F.substring_index(F.substring_index(path, "/", -2), "/", 1)


def safe_stem(path: Column) -> Column:
    """Base name without its last extension, safe for links and shells."""
    stem = F.regexp_replace(base_name(path), r"\.[^.]*$", "")
    # Characters beyond the first plane count as two units, neither of them a letter.
    stem = F.regexp_replace(stem, r"[\x{10000}-\x{10FFFF}]", "__")
    return F.regexp_replace(stem, r"[^\p{L}\p{N}.-]", "_")


def frame_name(stem: Column, source_id: Column, ms: Column, collides: Column) -> Column:
    return F.concat(stem, F.when(collides, F.concat(F.lit("-"), source_id)).otherwise(F.lit("")),
                    F.lit("-"), ms.cast("string"), F.lit(".png"))


def utf8_clip(text: Column, limit: Column | int = CLIP_BYTES) -> Column:
    """Longest prefix of at most ``limit`` UTF-8 bytes that splits no code point."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    raw = F.encode(text, "UTF-8")
    one = F.lit(1)
    cuts = [F.try_validate_utf8(F.substring(raw, one, F.greatest(limit - k, F.lit(0))).cast("string"))
            for k in range(4)]
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.coalesce(*cuts))


def sample_head(text: Column, limit: int = SAMPLE_BYTES) -> Column:
    """Whole text up to ``limit`` bytes, else its head cut after the last line break that fits.

    The break may be the byte right behind the slice, as in the original cut.
    """
    head = utf8_clip(text, limit + 1)
    upto = F.length(head) - F.instr(F.reverse(head), "\n") + 1
    return F.when(F.octet_length(text) <= limit, text).otherwise(
        F.when(F.instr(head, "\n") == 0, F.lit("")).otherwise(F.left(head, upto)))


def resolve_path(path: Column, directory: Column) -> Column:
    return F.when((path == "") | path.startswith("/"), path).otherwise(F.concat_ws("/", directory, path))


def literal_pattern(text: Column) -> Column:
    """A literal as a pattern: everything outside [A-Za-z0-9_] escaped."""
    return F.regexp_replace(text, r"([^A-Za-z0-9_])", r"\\$1")
