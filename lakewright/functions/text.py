"""Text expressions: normalising, tokens, excerpts, HTML, URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of documents and chunks, in characters.
TEXT_CAP, PAGE_CAP, SUMMARY = 900_000, 250_000, 180


#: What counts as white space in trims and collapses; the form works in Java and in RE2.
SPACE = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


#: The same as characters.
SPACES = "".join(map(chr, [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def normalise(text: Column) -> Column:
    """Unix line ends, no NUL, no blanks at line ends, at most two blank lines running, trimmed."""
    t = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), "\x00", "")
    return trimmed(F.regexp_replace(F.regexp_replace(t, r"[ \t]+\n", "\n"), r"\n{4,}", "\n\n\n"))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def excerpt(text: Column, terms: list[str], before: int = 260, after: int = 900) -> Column:
    """A window around the earliest hit of any term in the collapsed text, trimmed; without a hit the text's start."""
    flat = collapsed(text)
    at = F.least(*[F.when(F.instr(F.lower(flat), t) > 0, F.instr(F.lower(flat), t)) for t in terms], F.lit(None).cast("int"))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at.isNull(), F.left(flat, F.lit(after))).otherwise(F.trim(F.substring(flat, start, at - start + after)))


def strip_html(html: Column) -> Column:
    """Scripts, styles and comments go, block ends become line ends, entities are decoded once, &amp; first."""
    t = F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style\b[^>]*>.*?</style>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)</(p|div|section|article|header|footer|li|tr|h[1-6])>|<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.left(t, F.lit(PAGE_CAP))


def canonical_url(url: Column) -> Column:
    """Without fragment, the scheme's own port and final slashes, host in lower case, parameters in order of their names."""
    bare = F.regexp_replace(url, r"#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z]+)://", 1))
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z]+://([^/?]*)", 1))
    host = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z]+://[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    pairs = F.array_sort(F.transform(F.split(query, "&"), lambda x, i: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("name"), i.alias("at"), x.alias("pair"))))
    ordered = F.array_join(F.transform(pairs, lambda x: x["pair"]), "&")
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), ordered)))


#: Character sequences that tell of a wrong decoding.
MOJIBAKE = ("\ufffd", "锟", "Ã", "Â", "â€", "â€™", "â€œ", "â€\x9d", "琚", "佸", "鍦", "涓", "鏄", "寤", "骞", "鏈", "鏃", "鈥")


def decode_score(text: Column) -> Column:
    """20 for each marker, 10 for each control character but tab and line ends, 50 more for each replacement character."""
    count = lambda m: (F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))) / len(m)
    controls = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    return (20 * sum(count(m) for m in MOJIBAKE) + 10 * controls + 50 * count("\ufffd")).cast("long")


def file_name(text: Column) -> Column:
    """White space becomes _, only letters, digits, _ and Chinese characters stay, 80 at most."""
    clean = F.regexp_replace(F.regexp_replace(text, SPACE + "+", "_"), r"[^\x{4E00}-\x{9FA5}a-zA-Z0-9_]", "")
    return F.left(F.regexp_replace(clean, "_+", "_"), F.lit(80))
