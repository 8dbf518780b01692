"""Text functions as columns: tokens, slugs, name predicates, chunk splitting, HTML stripping and escaping."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .ids import SPACE, col, strip

#: Words that carry no meaning for linking by shared words. Add a vendor's or product line's name as needed.
STOPWORDS = (
    "the a an and or of to in on for with without your you this that these those is are be by from at as it its their them they "
    "we our using use used into not no non device devices surface guide service should must may can will if when before after "
    "during while replace replacement install installation remove removal also other more most some any all per via due such "
    "only than then them this that have has had been being which what when where how who whom each"
).split()
#: Words that do not tie a procedure to its fragments.
ROLLUP_STOPWORDS = "the a an of to and or for with this that process replacement remove install removal installation procedure device devices surface step steps guide service new old".split()
#: What makes a procedure a diagnostic one.
DIAGNOSTIC_STEMS = "sdt diagnos check test inspect validat verify status troubleshoot detect scan".split()
#: Names that are no product model, and words of which a model's name holds one.
GENERIC_MODELS = ["model", "models", "device", "devices", "this device model", "device model", "unit", "units", "product", "products"]
MODEL_WORDS = ["surface", "laptop", "pro", "studio", "go", "book", "hub"]
UMBRELLA = "(?i)replacement process$|\\breplacement$|\\bprocess$"


def words(c) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def tokens(c, least: int, stop: list[str]) -> Column:
    """The distinct words of at least so many characters that are not stop words."""
    return F.array_distinct(F.filter(words(c), lambda w: (F.length(w) >= least) & ~w.isin(stop)))


def salient_tokens(c, extra: list[str] = ()) -> Column:
    return tokens(c, 4, [*STOPWORDS, *extra])


def rollup_nouns(c, extra: list[str] = ()) -> Column:
    return tokens(c, 3, [*ROLLUP_STOPWORDS, *extra])


def is_specific_model(c, model_words: list[str] = MODEL_WORDS) -> Column:
    name = F.lower(strip(F.coalesce(col(c), F.lit(""))))
    holds = F.lit(False)
    for w in model_words:
        holds = holds | name.contains(w)
    return (name != "") & ~name.isin(GENERIC_MODELS) & holds & (name.rlike("\\d") | name.contains("edition"))


def is_diagnostic(c) -> Column:
    return F.lower(F.coalesce(col(c), F.lit(""))).rlike("|".join(DIAGNOSTIC_STEMS))


def is_umbrella(c) -> Column:
    return F.coalesce(col(c), F.lit("")).rlike(UMBRELLA)


def slug(c) -> Column:
    out = F.lower(F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), "[^0-9a-zA-Z]+", "_"), F.lit("_")))
    return F.when(out == "", "x").otherwise(out)


def file_key(c) -> Column:
    """A name fit for a file: 40 safe characters and 12 of the hash."""
    safe = F.substring(F.regexp_replace(col(c), "[^A-Za-z0-9._-]+", "_"), 1, 40)
    return F.concat(safe, F.lit("_"), F.substring(F.sha2(col(c).cast("binary"), 256), 1, 12))


def truthy_list(c) -> Column:
    """null becomes the empty list, null items go."""
    return F.filter(F.coalesce(col(c), F.array().cast("array<string>")), lambda x: x.isNotNull())


def search_aliases(key, name, aliases) -> Column:
    """The key, the name and the aliases in lower case, first of each."""
    return F.array_distinct(F.concat(F.array(col(key), F.lower(col(name))), F.transform(truthy_list(aliases), lambda a: F.lower(a))))


def split_text(c, target: int = 1000, longest: int = 1500) -> Column:
    """Chunks of a text: whole up to `longest`; else parts by blank lines (or by lines, if there is no blank one) packed
    greedily up to `target`; a part over `longest` is cut every `target` characters."""
    text = strip(F.coalesce(col(c), F.lit("")))
    blank = f"\\n{SPACE}*\\n"
    parts = F.when(text.rlike(blank), F.split(text, blank)).otherwise(F.split(text, "\\n"))
    parts = F.filter(F.transform(parts, strip), lambda p: p != "")
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("now"), empty.alias("out"))

    def flushed(a: Column) -> Column:
        return F.when(a["now"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["now"])))

    def step(a: Column, p: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(p), F.lit(target)), lambda i: F.substring(p, i, F.lit(target)))
        fits = (a["now"] != "") & (F.length(a["now"]) + 2 + F.length(p) <= target)
        return (
            F.when(F.length(p) > longest, F.struct(F.lit("").alias("now"), F.concat(flushed(a), cut).alias("out")))
            .when(fits, F.struct(F.concat(a["now"], F.lit("\n\n"), p).alias("now"), a["out"].alias("out")))
            .otherwise(F.struct(p.alias("now"), flushed(a).alias("out")))
        )

    packed = F.aggregate(parts, start, step, flushed)
    return F.when(text == "", empty).when(F.length(text) <= longest, F.array(text)).otherwise(packed)


def escape_html(c) -> Column:
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def strip_html(c) -> Column:
    """Text of an HTML fragment: tags become a space, white space runs one space, common references are decoded."""
    out = F.regexp_replace(F.coalesce(col(c), F.lit("")), "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->|<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&nbsp;", "\xa0"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, f"{SPACE}+", " "))


def parse_timestamp(c) -> Column:
    """ISO text to a timestamp in UTC; what cannot be read is null."""
    return F.try_to_timestamp(F.replace(col(c).cast("string"), F.lit("T"), F.lit(" ")))


def points(c) -> Column:
    """A flat list of numbers as pairs; an odd tail goes."""
    n = F.floor(F.size(col(c)) / 2).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(F.get(col(c), 2 * i), F.get(col(c), 2 * i + 1)))
    return F.when(n >= 1, pairs).otherwise(F.array().cast("array<array<double>>"))


def normalized_points(c, width, height) -> Column:
    """Pairs as shares of the page's size, six decimals; empty if the size is unknown or not positive."""
    scaled = F.transform(points(c), lambda p: F.array(F.round(p[0] / col(width), 6), F.round(p[1] / col(height), 6)))
    return F.when((col(width) > 0) & (col(height) > 0), scaled).otherwise(F.array().cast("array<array<double>>"))


def route(path) -> Column:
    """The source type of a path by its extension; an error for others."""
    ext = F.lower(F.regexp_extract(col(path), "(\\.[^./]+)$", 1))
    out = F.when(ext.isin(".csv", ".tsv"), F.substring(ext, 2, 3))
    for kinds, name in (((".xlsx",), "xlsx"), ((".pdf",), "pdf"), ((".docx",), "docx"), ((".html", ".htm"), "html"), ((".md",), "markdown")):
        out = out.when(ext.isin(*kinds), name)
    return out.otherwise(F.raise_error(F.concat(F.lit("unsupported file type: "), col(path))))
