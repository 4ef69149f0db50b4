"""String functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English nouns with a plural of their own, by vowel change, old endings, Greek and Latin endings.
IRREGULAR = {
    "men": "man", "women": "woman", "feet": "foot", "teeth": "tooth", "geese": "goose", "mice": "mouse", "lice": "louse",
    "children": "child", "oxen": "ox", "people": "person",
    "criteria": "criterion", "phenomena": "phenomenon", "analyses": "analysis", "hypotheses": "hypothesis", "crises": "crisis",
    "indices": "index", "vertices": "vertex", "matrices": "matrix", "data": "datum", "bacteria": "bacterium", "nuclei": "nucleus", "alumni": "alumnus",
}

JAPANESE = "[ぁ-んァ-ン一-龯]"


def file_type(path: Column) -> Column:
    """Kind of a file by the extension of its path, without query and fragment; txt if unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    known = F.when(ext.isin("md", "markdown"), "md")
    for kind in ("pdf", "docx", "xlsx", "pptx", "sysml"):
        known = known.when(ext == kind, kind)
    return known.otherwise("txt")


def language(text: Column) -> Column:
    """ja, en, mixed or unknown, by the scripts found."""
    ja, en = text.rlike(JAPANESE), text.rlike("[A-Za-z]")
    return F.when(ja & en, "mixed").when(ja, "ja").when(en, "en").otherwise("unknown")


def query_type(query: Column) -> Column:
    """keyword for short queries and those with digits or path-like signs, else semantic."""
    return F.when((F.char_length(query) <= 10) | query.rlike(r"[0-9:/\\._-]"), "keyword").otherwise("semantic")


def weights(kind: Column) -> tuple[Column, Column]:
    """(vector, text) weights of a query type."""
    return F.when(kind == "keyword", F.lit(0.45)).otherwise(F.lit(0.8)), F.when(kind == "keyword", F.lit(0.55)).otherwise(F.lit(0.2))


def normal_name(name: Column) -> Column:
    """Lower case, ASCII letters, digits, underscores and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9_ ]", ""), " +", " "))


def variants(word: Column) -> Column:
    """A word with its singular or plural forms, without repeats."""
    plural = {v: k for k, v in IRREGULAR.items()}
    irregular = F.lit(None).cast("string")
    for k, v in (IRREGULAR | plural).items():
        irregular = F.when(word == k, v).otherwise(irregular)
    n = F.char_length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    other = (
        F.when(word.endswith("ies") & (n > 3), F.concat(cut(3), F.lit("y")))
        .when(word.endswith("es") & (n > 3), cut(2))
        .when(word.endswith("s") & (n > 2), cut(1))
        .when(word.rlike("[^aeiou]y$"), F.concat(cut(1), F.lit("ies")))
        .when(word.rlike("(s|x|z|ch|sh)$"), F.concat(word, F.lit("es")))
        .otherwise(F.concat(word, F.lit("s")))
    )
    return F.array_distinct(F.array(word, F.coalesce(irregular, other)))


def sentences(text: Column) -> Column:
    """Trimmed, non-empty parts between runs of sentence ends and line ends."""
    return F.filter(F.transform(F.split(text, "[。！？.!?\n]+"), lambda s: F.trim(s)), lambda s: s != "")


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def snippet(text: Column, term: str, longest: int) -> Column:
    """The text around the first place of a term, with dots where it is cut; short texts stay whole."""
    at = F.greatest(F.instr(F.lower(text), term.lower()) - 1 - longest // 3, F.lit(0))
    piece = F.substring(text, at + 1, F.lit(longest))
    cut = F.concat(F.when(at > 0, "...").otherwise(""), piece, F.when(at + longest < F.char_length(text), "...").otherwise(""))
    return F.when(F.char_length(text) <= longest, text).otherwise(cut)


def highlighted(text: Column, term: str) -> Column:
    """Each occurrence of a term, in any case, written as **term**."""
    return F.regexp_replace(text, f"(?i){term}", f"**{term}**")


def normal_message(message: Column) -> Column:
    """A message with quoted parts and numbers replaced by marks, so that like messages are equal."""
    return F.regexp_replace(F.regexp_replace(message, '"[^"]*"|\'[^\']*\'', "<X>"), "[0-9]+([.][0-9]+)?", "<N>")


def is_contents_page(text: Column) -> Column:
    """Whether a text looks like a table of contents: many of its non-empty lines end in page numbers or dots."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    ends = F.filter(lines, lambda x: x.rlike(r"([. ]{3,}[0-9]+$)|(^[0-9]+([.][0-9]+)* .*[0-9]+$)|^(contents|table of contents|index)$"))
    short = F.filter(lines, lambda x: F.char_length(x) < 40)
    n = F.greatest(F.size(lines), F.lit(1))
    return (F.size(ends) / n >= 0.3) | ((F.size(short) / n >= 0.6) & (F.size(ends) / n >= 0.1))


def refuses(text: Column, markers: tuple[str, ...]) -> Column:
    """Whether a text holds any of some markers."""
    found = F.lit(False)
    for m in markers:
        found = found | F.contains(F.lower(text), F.lit(m))
    return found


def qualified_parts(name: Column) -> Column:
    """The parts of a qualified name between ::, without quotes around them."""
    return F.transform(F.split(name, "::"), lambda p: F.regexp_replace(F.trim(p), "^'(.*)'$", "$1"))


def balanced(text: Column) -> Column:
    """Whether parentheses close in order: never more closed than opened, and none left open. Null counts as empty."""
    signs = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "[^()]", ""), "")
    step = lambda d, c: F.when(d < 0, d).when(c == "(", d + 1).when(c == ")", d - 1).otherwise(d)
    return F.aggregate(signs, F.lit(0), step) == 0


def slug(name: Column) -> Column:
    """Lower-case runs of letters and digits with hyphens between."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def tool_name(server: Column, tool: Column, longest: int = 64) -> Column:
    """slug__tool in at most `longest` characters; the server's name is cut, the tool's only if it is too long by itself."""
    room = F.greatest(F.lit(longest) - 2 - F.char_length(tool), F.lit(0))
    return F.substring(F.concat(F.substring(slug(server), F.lit(1), room), F.lit("__"), tool), 1, longest)


def first_filled(*columns: Column) -> Column:
    """The first of some columns that is neither null nor empty."""
    return F.coalesce(*(F.when(c != "", c) for c in columns))


def file_key(path: Column, document: Column, chunk: Column) -> Column:
    """What tells a chunk's file: its path, or its document's id, or its own id up to the last hyphen."""
    return first_filled(path, document, F.regexp_replace(chunk, "-[^-]*$", ""))


def chunk_number(index: Column, chunk: Column) -> Column:
    """A chunk's number, as given or as its id ends with; null if neither is a number."""
    return F.coalesce(index.try_cast("int"), F.regexp_extract(chunk, "([0-9]+)$", 1).try_cast("int"))


def replaced_between(text: Column, find: Column, put: Column, start: Column, end: Column) -> Column:
    """text with the first `find` inside the places start to end (from 0, both included) replaced; as it is if there is none."""
    inside = F.substring(text, start + 1, end - start + 1)
    at = F.call_function("instr", inside, find)
    done = F.concat(F.substring(text, F.lit(1), start + at - 1), put, F.substring(text, start + at + F.char_length(find), F.char_length(text)))
    return F.when((at > 0) & (F.char_length(find) > 0), done).otherwise(text)


def error_class(message: Column) -> Column:
    """The class of a message by the first of some patterns: syntax, then types, then the rest."""
    low = F.lower(message)
    return F.when(low.rlike("syntax|parse|unexpected|missing"), "syntax").when(low.rlike("type|resolve|reference"), "type resolution").otherwise("semantic")
