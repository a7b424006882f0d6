"""String, URL and hashing expressions (Column -> Column)."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as V


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strings(values: Sequence[str]) -> Column:
    """Constant string array (one literal, folded by the optimizer)."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


def choose(pairs: Sequence[tuple[Column, Column]], default: Column | None = None) -> Column:
    """CASE WHEN over (condition, value) pairs, first hit wins."""
    (cond, val), *rest = pairs
    expr = F.when(cond, val)
    for cond, val in rest:
        expr = expr.when(cond, val)
    return expr if default is None else expr.otherwise(default)


def lookup(c: Column, table: dict, default: Column | None = None) -> Column:
    """Value of the constant table for the key, else the default."""
    kind = {str: "string", int: "int", float: "double"}[type(next(iter(table.values())))]
    hit = F.try_element_at(F.from_json(F.lit(json.dumps(table)), f"map<string,{kind}>"), c)
    return hit if default is None else F.coalesce(hit, default)


# ---- accents -----------------------------------------------------------------------------------------------------
def _tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility decomposition of the basic plane without marks, derived from the Unicode data: translate() arguments for letters that stay one, a map
    for those that become several.  Hangul syllables are left whole."""
    source, target, wide, dropped = [], [], {}, []
    for cp in range(0x80, 0x10000):
        ch = chr(cp)
        if unicodedata.combining(ch):
            dropped.append(ch)
            continue
        if 0xAC00 <= cp < 0xD7A4 or unicodedata.is_normalized("NFKD", ch):
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if len(plain) == 1:
            source.append(ch)
            target.append(plain)
        else:
            wide[ch] = plain
    return "".join(source + dropped), "".join(target), wide  # no target: translate() deletes


_FROM, _TO, _WIDE = _tables()


def _ranges(letters: Sequence[str], gap: int = 16) -> str:
    """A character class of few ranges that holds the letters, and some between them."""
    out: list[list[int]] = []
    for cp in sorted(map(ord, letters)):
        if out and cp - out[-1][1] <= gap:
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


_WIDE_LETTER = _ranges(list(_WIDE))


def strip_accents(c: Column | str) -> Column:
    """Letters without accents, compatibility letters (ligatures, fractions, roman and circled numbers) as plain ones; only texts that hold one that becomes several are taken apart."""
    x = _col(c)
    known = F.from_json(F.lit(json.dumps(_WIDE)), "map<string,string>")
    apart = F.array_join(F.transform(F.split(x, ""), lambda ch: F.coalesce(F.try_element_at(known, ch), ch)), "")
    plain = F.translate(F.when(x.rlike(_WIDE_LETTER), apart).otherwise(x), _FROM, _TO)
    return F.when(F.octet_length(x) == F.char_length(x), x).otherwise(plain)  # one byte a letter: nothing to strip


@F.pandas_udf(T.StringType())
def strip_accents_any(s: pd.Series) -> pd.Series:
    """Full Unicode accent removal, Arrow batches."""
    decomposed = s.str.normalize("NFKD")
    return decomposed.map(lambda x: None if x is None else "".join(ch for ch in x if not unicodedata.combining(ch)))


# ---- names and titles --------------------------------------------------------------------------------------------
def normalize_name(c: Column | str) -> Column:
    x = F.lower(strip_accents(c))
    x = F.replace(F.replace(x, F.lit("&"), F.lit(" and ")), F.lit("'"), F.lit(""))
    return F.coalesce(F.trim(F.regexp_replace(x, "[^a-z0-9]+", " ")), F.lit(""))


def name_tokens(c: Column | str) -> Column:
    return F.filter(F.split(normalize_name(c), " "), lambda t: t != "")


def normalize_title(c: Column | str) -> Column:
    return F.array_join(F.filter(name_tokens(c), lambda t: ~t.isin(V.TITLE_STOP_WORDS)), " ")


def clean_title(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?U)\s+", " "))


def normalize_postcode(c: Column | str) -> Column:
    pc = F.regexp_replace(F.upper(_col(c)), r"\s+", "")
    n = F.length(pc)
    return F.when(n.between(5, 7), F.concat(F.left(pc, n - 3), F.lit(" "), F.right(pc, F.lit(3))))


def slugify(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normalize_status(c: Column | str) -> Column:
    word = F.regexp_replace(F.element_at(F.split(F.lower(_col(c)), "/"), -1), "[^a-z]", "")
    return F.coalesce(lookup(word, V.STATUS_WORDS), F.lit("SCHEDULED"))


# ---- URLs --------------------------------------------------------------------------------------------------------
_URL_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
_URL_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
_URL_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"


def normalize_url(c: Column | str) -> Column:
    u = F.trim(_col(c))
    u = F.when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit("https://"), u))
    return F.when(F.length(F.trim(_col(c))) > 0, u)


def url_depth(c: Column | str) -> Column:
    """Number of non-empty path segments."""
    return F.size(F.filter(F.split(F.regexp_extract(_col(c), _URL_PATH, 1), "/"), lambda p: p != ""))


def more_specific(new: Column, old: Column) -> Column:
    return url_depth(new) > url_depth(old)


def merge_url(new: Column, old: Column) -> Column:
    """Keep the stored URL unless the incoming one has a deeper path."""
    return F.when(new.isNotNull() & (old.isNull() | more_specific(new, old)), new).otherwise(old)


def url_scheme(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(c), _URL_SCHEME, 1))


def url_host(c: Column | str) -> Column:
    """Host without credentials, port, trailing dot or IPv6 brackets."""
    auth = F.regexp_extract(_col(c), _URL_AUTHORITY, 1)
    auth = F.regexp_replace(auth, "^.*@", "")
    bare = F.when(auth.startswith("["), F.regexp_extract(auth, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(auth, ":[0-9]*$", ""))
    return F.regexp_replace(F.lower(bare), r"\.+$", "")


def host_allowed(host: Column | str, domains: Sequence[str] | None) -> Column:
    if not domains:
        return F.lit(True)
    h = F.lower(_col(host))
    hit = F.lit(False)
    for d in domains:
        hit = hit | (h == d) | h.endswith("." + d)
    return hit


def _private_ipv4(h: Column) -> Column:
    is_ip = h.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$")
    reserved = (r"^(?:0|10|127|2(?:2[4-9]|[345][0-9]))\.|^169\.254\.|^192\.168\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^198\.1[89]\."
                r"|^192\.0\.(?:0|2)\.|^198\.51\.100\.|^203\.0\.113\.")
    return is_ip & h.rlike(reserved)


def _private_ipv6(h: Column) -> Column:
    return h.contains(":") & (h.isin("::", "::1") | h.rlike(r"^(?:f[cd]|fe[89ab]|ff)|^2001:db8:|^::ffff:"))


def url_problem(c: Column | str, domains: Sequence[str] | None = None) -> Column:
    """Null for a URL that may be followed, otherwise the first rule it breaks (no name resolution)."""
    u = _col(c)
    h = url_host(u)
    blocked = (h == "") | h.isin(V.BLOCKED_HOSTS) | h.rlike(r"\.(?:localhost|internal|local)$")
    return choose([
        (u.isNull() | ~url_scheme(u).isin("http", "https"), F.lit("scheme")),
        (blocked, F.lit("host")),
        (F.regexp_extract(u, _URL_AUTHORITY, 1).contains("@"), F.lit("credentials")),
        (_private_ipv4(h) | _private_ipv6(h), F.lit("private_ip")),
        (~host_allowed(h, domains), F.lit("not_in_allowlist")),
    ])


# ---- hashing -----------------------------------------------------------------------------------------------------
def fingerprint(title: Column, date_start: Column, venue: Column, city: Column) -> Column:
    key = F.concat_ws("|", normalize_title(title), date_start.cast("string"), normalize_name(venue), normalize_name(city))
    return F.sha2(key, 256)


def external_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 20)


def payload_hash(payload: Column) -> Column:
    """Digest of a struct, fields taken in the order given, nulls kept."""
    return F.sha2(F.to_json(payload, {"ignoreNullFields": "false"}), 256)


# ---- keyword rules -----------------------------------------------------------------------------------------------
def keyword_hit(text: Column, keywords: Sequence[str]) -> Column:
    """First keyword of the list found in the padded lower-case text, else null."""
    t = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return F.coalesce(*[F.when(t.contains(k), F.lit(k)) for k in keywords])


def non_event_title(title: Column, patterns: Sequence[str] = tuple(V.NON_EVENT_TITLE_PATTERNS)) -> Column:
    return once(F.lower(F.coalesce(title, F.lit(""))), lambda t: reduce(or_, [F.contains(t, F.lit(p)) for p in patterns]))


def split_hint(hint: Column) -> tuple[Column, Column]:
    """(strong part, weak part) of a category hint; both null when absent."""
    at = F.instr(F.lower(hint), V.WEAK_HINT_PREFIX)
    strong = F.when(at > 0, F.trim(F.left(hint, at - 1))).otherwise(hint)
    weak = F.when(at > 0, F.trim(F.substring(hint, at + len(V.WEAK_HINT_PREFIX), F.length(hint))))
    return F.nullif(strong, F.lit("")), F.nullif(weak, F.lit(""))


def merge_hint(schema_type: Column, page_hint: Column) -> Column:
    """Schema type (when it says more than 'Event') in front of the page hint."""
    strong = F.when(F.lower(schema_type) != "event", F.nullif(schema_type, F.lit("")))
    return F.nullif(F.trim(F.concat_ws(" ", strong, F.nullif(F.trim(page_hint), F.lit("")))), F.lit(""))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _first_rule(text: Column, rules, confidence: float) -> Column:
    """struct(category, subcategory, confidence) of the first rule with a keyword in the text; null without one."""
    def chosen(padded: Column) -> Column:
        return choose([(reduce(or_, [F.contains(padded, F.lit(k.lower())) for k in keywords]),
                        F.struct(F.lit(cat).alias("category"), F.lit(sub).alias("subcategory"), F.lit(confidence).alias("confidence"))) for cat, sub, keywords in rules])

    return once(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), chosen)


def classify(title: Column, hint: Column | None = None, description: Column | None = None, rules=None) -> Column:
    """struct(category, subcategory, confidence): hint, title, description, weak hint; first text with any rule wins."""
    rules = rules or V.CATEGORY_RULES
    hint = F.lit(None).cast("string") if hint is None else hint
    strong, weak = split_hint(hint)
    levels = [(strong, V.HINT_CONFIDENCE), (F.coalesce(title, F.lit("")), V.TITLE_CONFIDENCE)]
    if description is not None:
        levels.append((F.nullif(description, F.lit("")), V.TEXT_CONFIDENCE))
    levels.append((weak, V.WEAK_CONFIDENCE))
    found = [_first_rule(text, rules, conf) for text, conf in levels]
    fallback = F.struct(F.lit(V.DEFAULT_CATEGORY[0]).alias("category"), F.lit(V.DEFAULT_CATEGORY[1]).alias("subcategory"),
                        F.lit(V.DEFAULT_CONFIDENCE).alias("confidence"))
    return F.coalesce(*found, fallback)
