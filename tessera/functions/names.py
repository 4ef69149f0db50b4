"""Names of elements and terms: where they stand in sentences, how they are written, and how much they say of the domain."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the domain by how central they are, and words that make a name a general one.
CORE = ("part", "item", "action", "port", "interface", "constraint", "requirement", "case")
RELATED = ("attribute", "reference", "calculation", "analysiscase", "verificationcase", "usecase", "view", "rendering", "metadata", "enumeration")
RELATED_ALONE = ("connectionusage", "flowconnectionusage", "successionusage", "allocationusage", "viewpointdefinition")
LINKING = ("specializes", "subsets", "redefines", "types", "membership", "ownership", "feature", "featureusage", "namespace", "package", "library")
GENERAL = ("definition", "usage", "part", "item", "action", "port", "interface", "attribute", "reference", "connection", "constraint", "requirement", "case")


def domain_priority(name: Column) -> Column:
    """1.0 for core kinds, 0.8 for related ones, 0.6 for words that link, 0.4 for names with a general word inside, else 0."""
    low = F.lower(name)
    both = lambda kinds: [f"{k}{end}" for k in kinds for end in ("definition", "usage")]
    general = low.rlike("|".join(GENERAL))
    return F.when(low.isin(*both(CORE)), 1.0).when(low.isin(*both(RELATED), *RELATED_ALONE), 0.8).when(low.isin(*LINKING), 0.6).when(general, 0.4).otherwise(0.0)


def term_place(sentence: Column, term: str, phrase: bool = False) -> Column:
    """Where a term first stands in a sentence (from 0), -1 if nowhere.

    Terms of ASCII are whole words in any case: a name (phrase False) may have a plural ending; a phrase may follow other letters if it has several words, as spaces
    get lost, and has no plural. Other terms are found as they are.
    """
    if not term.isascii():
        return F.locate(term, sentence) - 1
    left = "" if phrase and " " in term else "(?<![0-9A-Za-z])"
    return F.regexp_instr(sentence, F.lit(f"(?i){left}{re.escape(term)}{'' if phrase else '(?:es|s)?'}(?![0-9A-Za-z])")) - 1


def aliases_in(text: Column, aliases: Mapping[str, tuple[str, ...]]) -> Column:
    """The names that aliases inside a text stand for, in order of the aliases, each once; an alias counts as a whole word or phrase."""
    own = [F.when(F.lower(text).rlike(rf"\b{re.escape(a.lower())}\b"), F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>")) for a, names in aliases.items()]
    return F.array_distinct(F.flatten(F.array(*own)))


def is_qualified(name: Column) -> Column:
    """Whether a name is made of identifiers with `::` between them; null is not."""
    return F.coalesce(name.rlike(r"^\s*[A-Za-z_][A-Za-z0-9_]*\s*(::\s*[A-Za-z_][A-Za-z0-9_]*\s*)*$"), F.lit(False))


def rebuilt(reference: Column, separator: str = ".") -> Column:
    """A reference with another sign between its parts; what is quoted stays."""
    return F.array_join(F.regexp_extract_all(reference, F.lit(r"('[^']*'|[^:.']+)"), F.lit(1)), separator)


SUFFIX = "_(def|usage|instance)$"


def search_terms(kind: Column, label: Column) -> Column:
    """What to search for an element: the words of its kind without def, usage or instance, then its label if that is another."""
    word, own = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(kind, F.lit("")), SUFFIX, ""), "_", " ")), F.trim(F.coalesce(label, F.lit("")))
    return F.array_distinct(F.filter(F.array(word, own), lambda x: x != ""))


def keyword(kind: Column) -> Column:
    """How a kind is written: definitions keep `def`, usages and instances lose their ending."""
    spaced = lambda c: F.regexp_replace(c, "_", " ")
    return F.when(kind.endswith("_def"), F.concat(spaced(F.regexp_replace(kind, "_def$", "")), F.lit(" def"))).otherwise(spaced(F.regexp_replace(kind, "_(usage|instance)$", "")))


def label(*names: Column) -> Column:
    """The first of some names that is not blank; `(unnamed)` if none is."""
    return F.coalesce(*(F.when(F.trim(n) != "", n) for n in names), F.lit("(unnamed)"))
