"""Text functions: normalising, gates and shapes as Columns; Unicode work in Arrow UDFs on distinct strings."""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = r"(?U)\s+"
#: Placeholders and junk, in lower case; "na" is not one, as it may be a code.
SENTINELS = frozenset(
    "unset undefined unspecified unknown null none n/a n.a. n.a tba tbc tbd todo pending misc miscellaneous other others various international worldwide "
    "dummy example placeholder sample test testing bar baz foo foobar lorem asdf asdfgh asdfghjkl qwerty zxcvbnm lkjhgfdsa mnbvcxz xkcd "
    "-- --- ---- .. ... ### **** ==== ____ ~~~~ //// !!!! ???? 0 00 000 0000 001 998 999 9999".split()
) | {"to do", "foo bar", "lorem ipsum", "test string", "not set", "not defined", "not specified", "not available", "not applicable"}
DEGENERATE = ("na", "n/a", "n.a.", "n.a", "n/k", "null", "none", "nan", "nil", "tbd", "tba", "unknown", "<null>", "#n/a", "?", "-", "--", "---", ".")


def squeeze(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed: normal form of ASCII text."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


@dataclass(frozen=True)
class Profile:
    """Which steps a normal form takes."""

    markup: bool = False
    punctuation: bool = False
    diacritics: bool = False
    digits: bool = False
    fold: bool = True
    spaces: bool = True


PROFILES = {
    "strict": Profile(spaces=False),
    "standard": Profile(),
    "aggressive": Profile(punctuation=True, diacritics=True),
    "geo": Profile(markup=True),
    "org": Profile(punctuation=True),
    "custom": Profile(),
}
_HINT = re.compile(r"[&#@>*_~`\[\]]")
_MARKDOWN = [(re.compile(r"(\*\*|__)(.+?)\1"), r"\2"), (re.compile(r"(?<!\w)[*_](.+?)[*_](?!\w)"), r"\1"), (re.compile(r"`([^`]*)`"), r"\1"), (re.compile(r"~~(.+?)~~"), r"\1"), (re.compile(r"^\s{0,3}(#{1,6}|>)\s+", re.M), ""), (re.compile(r"!?\[([^\]]*)\]\([^)]*\)"), r"\1")]


def normal_form(text: str | None, profile: Profile = PROFILES["standard"]) -> str | None:
    """Normal form of one string; None where nothing is left."""
    if text is None:
        return None
    if profile.markup and _HINT.search(text):
        text = html.unescape(text)
        for pattern, by in _MARKDOWN:
            text = pattern.sub(by, text)
    text = unicodedata.normalize("NFC", text)
    if profile.diacritics:
        text = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn"))
    if profile.spaces:
        text = " ".join(text.split())
    if profile.punctuation:
        text = " ".join(re.sub(r"[^\w\s\-']", "", text).split())
    if profile.digits:
        text = re.sub(r"\d", "", text)
    if profile.fold:
        text = text.casefold()
    return text or None


def normalise(text: Column, profile: str = "standard") -> Column:
    """Normal form of a column: native for ASCII values, which is most; an Arrow UDF for the rest."""
    p = PROFILES[profile]

    @F.pandas_udf(T.StringType())
    def unicode_form(s: pd.Series) -> pd.Series:
        forms = {v: normal_form(v, p) for v in s.dropna().unique()}
        return pd.Series([forms.get(v) if isinstance(v, str) else None for v in s], dtype="object")

    plain = text
    if p.spaces:
        plain = F.trim(F.regexp_replace(plain, r"\s+", " "))
    if p.punctuation:
        plain = F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\w\s\-']", ""), r"\s+", " "))
    if p.fold:
        plain = F.lower(plain)
    simple = ~text.rlike(r"[^\x20-\x7E]")
    if p.markup:
        simple = simple & ~text.rlike(r"[&#@>*_~`\[\]]")
    return F.when(simple, F.when(plain != "", plain)).otherwise(unicode_form(F.when(~simple, text)))


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", unicodedata.normalize("NFC", text).casefold()) if unicodedata.category(c) != "Mn")


@F.pandas_udf(T.StringType())
def fold_for_match(s: pd.Series) -> pd.Series:
    """Case and accents folded."""
    return pd.Series([fold(v) if isinstance(v, str) else None for v in s], dtype="object")


FOLDED = T.StructType([T.StructField("text", T.StringType()), T.StructField("offsets", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(FOLDED)
def fold_with_offsets(s: pd.Series) -> pd.DataFrame:
    """Folded text, and for each of its characters the place of the original one."""
    out = []
    for v in s:
        v = v if isinstance(v, str) else None
        folded, at = [], []
        for i, c in enumerate(v or ""):
            f = fold(c)
            folded.append(f)
            at += [i] * len(f)
        out.append(("".join(folded) if v is not None else None, at))
    return pd.DataFrame({"text": pd.Series([o[0] for o in out], dtype="object"), "offsets": pd.Series([o[1] for o in out], dtype="object")})


def aligned(text: str) -> tuple[str, list[int], list[int]]:
    """Case-folded, white space collapsed text; start and end in the raw text of each of its characters."""
    out, start, end = [], [], []
    i, n = 0, len(text)
    while i < n:
        j = i + 1
        while j < n and not text[i].isspace() and unicodedata.combining(text[j]):
            j += 1
        piece = unicodedata.normalize("NFC", text[i:j])
        if piece.isspace():
            while j < n and text[j].isspace():
                j += 1
            if out:
                out.append(" ")
                start.append(i)
                end.append(j)
        else:
            for c in piece.casefold():
                out.append(c)
                start.append(i)
                end.append(j)
        i = j
    if out and out[-1] == " ":
        out.pop(), start.pop(), end.pop()
    return "".join(out), start, end


ALIGNED = T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.ArrayType(T.IntegerType())), T.StructField("end", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(ALIGNED)
def align(s: pd.Series) -> pd.DataFrame:
    """Normal text with, for each of its characters, where it starts and ends in the raw text."""
    rows = [aligned(v) if isinstance(v, str) else (None, [], []) for v in s]
    return pd.DataFrame({k: pd.Series([r[i] for r in rows], dtype="object") for i, k in enumerate(("text", "start", "end"))})


def highlight(query: Column, display: Column, fuzzy: Column) -> Column:
    """Half-open range of code points of ``display`` that the folded query takes first; null for fuzzy matches and where it isn't found."""
    folded, of = fold_with_offsets(display), fold_for_match(query)
    at = F.when(F.length(of) > 0, F.instr(folded["text"], of))
    found = ~fuzzy & (at > 0)
    last = folded["offsets"][(at + F.length(of) - 2).cast("int")]
    return F.when(found, F.struct(folded["offsets"][(at - 1).cast("int")].alias("start"), (last + 1).alias("end")))


def tokenise(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda x: x != "")


def is_sentinel(text: Column) -> Column:
    """Placeholder or junk of at most 20 characters."""
    t = F.trim(text)
    return (F.length(t) <= 20) & F.lower(t).isin(*sorted(SENTINELS))


def is_degenerate(text: Column) -> Column:
    return F.lower(F.trim(text)).isin(*DEGENERATE)


def short_input_passes(text: Column, typed: Column | None = None) -> Column:
    """Letters alone, three at most, must be upper case and more than one; a typed context lets them pass."""
    t = F.trim(text)
    short = t.rlike("^[A-Za-z]{1,3}$")
    lone_lower = t.rlike("^[a-z]$")
    passes = ~short | t.rlike("^[A-Z]{2,3}$")
    if typed is None:
        return passes
    return (passes | typed) & ~lone_lower


def is_dotted_initialism(text: Column) -> Column:
    return F.trim(text).rlike(r"^(?:[A-Za-z]\.){2,}[A-Za-z]?\.?$")


def is_punctuation_noise(text: Column) -> Column:
    """Few letters are left without punctuation, and it isn't an initialism."""
    rest = F.translate(F.trim(text), "#/\\-_.,;:!?*|()[]{}'\"` ", "")
    return (rest != F.trim(text)) & (F.length(rest) <= 3) & ~rest.rlike("[0-9]") & ~is_dotted_initialism(text)


def is_acronym_like(text: Column) -> Column:
    """2 to 10 characters, half of them upper case, few vowels or short."""
    n = F.length(text)
    upper = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    vowels = F.length(F.regexp_replace(text, "[^AEIOUaeiou]", ""))
    return n.between(2, 10) & (upper / n >= 0.5) & ((vowels / n < 0.5) | (n <= 5))


def code_shape(text: Column) -> Column:
    """alpha, numeric, dcid, wikidata or null."""
    t = F.trim(text)
    return (
        F.when(t.rlike("^[A-Za-z]{2,3}$"), "alpha")
        .when(t.rlike("^[0-9]{3}$"), "numeric")
        .when(F.lower(t).rlike("^(wikidata:)?q[0-9]+$"), "wikidata")
        .when(t.rlike("^[a-z]+/[A-Za-z0-9_-]+$"), "dcid")
    )


def coerce_number(number: Column) -> Column:
    """A number as text; integral doubles lose their fraction."""
    return F.when(number == F.floor(number), F.floor(number).cast("bigint").cast("string")).otherwise(number.cast("string"))


def flag(iso2: Column) -> Column:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(iso2.rlike("^[A-Za-z]{2}$"), F.translate(F.upper(iso2), letters, "".join(chr(0x1F1E6 + i) for i in range(26))))


def lookup_values(text: Column) -> Column:
    """The spellings under which a code is looked up: as written, and numbers padded and stripped."""
    t = F.lower(F.trim(text))
    number = t.rlike("^[0-9]{1,3}$")
    stripped = F.regexp_replace(t, "^0+(?=.)", "")
    wikidata = F.regexp_replace(t, "^wikidata:", "")
    return F.array_distinct(F.when(number, F.array(t, F.lpad(stripped, 3, "0"), stripped)).otherwise(F.array(t, wikidata)))


def latin_share_ok(text: Column) -> Column:
    """Under a fifth of the letters are beyond the Latin blocks."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    other = F.length(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}]", ""), r"[\u0000-ɏ]", ""))
    return (letters > 0) & (other / letters < 0.2)


ORG_SUFFIX = r"[\s,]+(inc|incorporated|ltd|limited|llc|plc|ag|gmbh|sa|co|company|corp|corporation)\.?$"


def merge_form(text: Column) -> Column:
    """Normal form used when graphs are merged."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def org_form(text: Column) -> Column:
    return F.regexp_replace(merge_form(text), ORG_SUFFIX, "")


def corrupt(text: Column, kind: str, seed: Column) -> Column:
    """Deterministic corruption of a string: delete, insert, substitute, transpose, drop_word, reorder, truncate, upper, space."""
    n = F.length(text)
    at = F.pmod(seed, F.greatest(n - 1, F.lit(1))).cast("int") + 1
    left = lambda k: F.substring(text, F.lit(1), k)
    right = lambda k: F.substring(text, k, n)
    words = F.split(text, " ")
    changed = {
        "delete": F.concat(left(at - 1), right(at + 1)),
        "insert": F.concat(left(at), F.lit("x"), right(at + 1)),
        "substitute": F.concat(left(at - 1), F.lit("x"), right(at + 1)),
        "transpose": F.concat(left(at - 1), F.substring(text, at + 1, F.lit(1)), F.substring(text, at, F.lit(1)), right(at + 2)),
        "drop_word": F.when(F.size(words) >= 3, F.array_join(F.slice(words, 1, F.size(words) - 1), " ")).otherwise(text),
        "reorder": F.array_join(F.reverse(words), " "),
        "truncate": F.array_join(F.transform(words, lambda w: F.substring(w, 1, 4)), " "),
        "upper": F.upper(text),
        "space": F.concat(left(at), F.lit(" "), right(at + 1)),
    }[kind]
    return F.when(n < 5, text).otherwise(changed)
