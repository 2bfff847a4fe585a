"""What a shopper's message says: pure functions of text, and the columns that need no Python."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillsift.functions import vocabulary as V
from quillsift.functions.text import blank, hits, joined, last, map_pairs_text, once

IGNORE = re.IGNORECASE


@dataclass(frozen=True)
class Reply:
    """A message without what it excludes, what it excludes, and the attributes it has no preference for."""

    query_text: str
    excluded: dict[str, set[str]] = field(default_factory=dict)
    no_preference: set[str] = field(default_factory=set)


#: Any value that can be excluded, as one pattern whose groups are the attributes.
EXCLUDABLE = r"\b(?:" + "|".join(f"(?P<{attribute}>{words})" for attribute, words in V.EXCLUDABLE_VALUES.items()) + r")\b"


class Mark(NamedTuple):
    """A stretch of a message that says what is not wanted: of an attribute this value, or any (None)."""

    start: int
    end: int
    attribute: str
    value: str | None = None


def marks(plain: str) -> Iterator[Mark]:
    for clause in re.finditer(V.NO_PREFERENCE, plain, IGNORE):
        yield Mark(*clause.span(), re.sub(r"\s", "_", clause[1].lower()))
    for found in re.finditer(EXCLUDABLE, plain, IGNORE):
        before = plain[: found.start()][-V.NEGATION_REACH :]
        if negation := re.search(V.NEGATION, before, IGNORE):
            yield Mark(found.start() - len(before) + negation.start(), found.end(), found.lastgroup, found[0].lower())


def purify(text: str | None) -> Reply:
    """A message with all marked stretches taken out; stretches may overlap, so words after a negation stay."""
    plain = " ".join((text or "").split())
    found = list(marks(plain))
    gone = {at for mark in found for at in range(mark.start, mark.end)}
    kept = "".join(" " if at in gone else sign for at, sign in enumerate(plain))
    excluded = {a: {m.value for m in found if m.attribute == a and m.value} for a in dict.fromkeys(m.attribute for m in found if m.value)}
    return Reply(" ".join(kept.split()).strip(" ,;."), excluded, {m.attribute for m in found if m.value is None})


def kinds(colors: tuple[str, ...]) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Kinds of constraints and the words one of which they hold, in the order they are tried."""
    return (("material", V.MATERIALS), ("color", ("color", *colors)), ("size", V.SIZE_HINTS), ("style", V.STYLE_HINTS), ("use_case", V.USE_HINTS))


def kind_of(constraint: str, colors: tuple[str, ...] = V.COLORS) -> str:
    """The attribute that a constraint is about."""
    text = constraint.lower()
    tried = [("budget", re.search(V.BUDGET_HINT, text)), *((kind, any(w in text for w in words)) for kind, words in kinds(colors)), ("feature", True)]
    return next(kind for kind, held in tried if held)


def kind_column(constraint: Column, colors: tuple[str, ...] = V.COLORS) -> Column:
    """kind_of() as a column."""
    text = F.lower(blank(constraint))
    kind = F.when(text.rlike(V.BUDGET_HINT), "budget")
    for name, words in kinds(colors):
        kind = kind.when(hits(text, words), name)
    return kind.otherwise("feature")


#: How a constraint of a kind names its value; where it does not, its words are looked for, and else it is the value itself.
NAMED = {"budget": r"(\d+(?:\.\d+)?)", "color": r"color[:\s]+(\w+)"}
LISTED = {"material": V.MATERIALS, "color": V.COLORS}


def value_of(constraint: str, kind: str) -> str:
    """The value that a constraint of this kind states; of several words the first in the list."""
    text = constraint.lower().strip()
    named = re.findall(NAMED[kind], text) if kind in NAMED else []
    listed = [w for w in LISTED.get(kind, ()) if w in text]
    own = [] if kind in NAMED or kind in LISTED else [re.sub(r"^\w[\w\s]+?:\s*", "", text).strip()]
    return next(filter(None, (*named, *listed, *own)), text)


def stated_slots(text: str) -> dict[str, str]:
    """Slots that patterns find in free text; of a slot's patterns the first that does."""
    found = ((slot, match) for slot, patterns in V.SLOT_PATTERNS.items() for match in (re.search(p, text.lower()) for p in reversed(patterns)) if match)
    values = {slot: match[1] for slot, match in found}  # the last of the reversed patterns stays
    return {slot: values[slot] for slot in V.SLOT_PATTERNS if slot in values}


def listed_slots(raw: str) -> dict[str, str]:
    """Slots of constraints between semicolons, in the order they come up: of each kind the last, then what patterns find beside, the first."""
    said = [(kind_of(part), part, stated_slots(part)) for part in map(str.strip, raw.strip(". ").split(";")) if part]
    named = {kind: value_of(part, kind) for kind, part, _ in said}
    beside = {slot: value for *_, found in reversed(said) for slot, value in found.items()}
    return {slot: (beside | named)[slot] for slot in dict.fromkeys(x for kind, _, found in said for x in (kind, *found))}


def coarse_category(categories: Column) -> Column:
    """The last two parts of comma-separated categories that are not the root."""
    parts = F.transform(F.flatten(F.transform(categories, lambda c: F.split(c, ","))), lambda p: F.btrim(p))
    useful = F.filter(parts, lambda p: (p != "") & ~F.lower(p).isin(*V.ROOT_CATEGORIES))
    return F.coalesce(F.nullif(F.array_join(last(useful, 2), " "), F.lit("")), F.lit("clothing item"))


def clean_constraint(text: Column, most: int = 180) -> Column:
    """Single blanks, no marks at the ends, at most so many characters."""
    plain = F.btrim(F.regexp_replace(blank(text), r"\s+", " "), F.lit(" -;,.\t\n"))
    return F.rtrim(F.substring(plain, 1, most))


def matching_text(product: dict[str, Column]) -> Column:
    """All of a product's fields, details as key and value; columns by field."""
    parts = [product["title"], joined(product["features"]), map_pairs_text(product["details"]), product["description"], joined(product["categories"]), product["store"]]
    return F.btrim(F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts)))


def intent_card(product: dict[str, Column], most: int = 180) -> Column:
    """struct(target_category, hard_constraints, soft_preferences): what a simulated shopper of a product wants.

    Material first, color second, then features and details, the budget last; two of them hard, two soft.
    """
    none = F.lit([]).cast("array<string>")
    stated = F.concat(F.coalesce(F.filter(product["features"], lambda f: f.isNotNull() & (f != "")), none), F.coalesce(F.transform(F.filter(F.map_entries(product["details"]), lambda e: e["value"].isNotNull() & (e["value"] != "")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), none))
    # arrays of one text or none, so that each is named once
    word = lambda text, attribute: F.filter(F.array(F.lower(F.regexp_extract(text, rf"(?iU)\b({V.CATALOG_VALUES[attribute]})\b", 1))), lambda x: x != "")
    color = lambda text: F.transform(word(text, "color"), lambda x: F.concat(F.lit("color: "), x))
    budget = F.filter(F.array(F.concat(F.lit("budget around $"), product["price"].cast("string"))), lambda x: x.isNotNull() & (x != "budget around $"))
    found = once(matching_text(product), lambda text: F.struct(F.concat(word(text, "material"), stated).alias("first"), color(text).alias("color")))
    wanted = once(found, lambda x: F.concat(F.slice(x["first"], 1, 1), x["color"], F.slice(x["first"], F.lit(2), F.greatest(F.size(x["first"]), F.lit(1))), budget))
    clean = F.array_distinct(F.filter(F.transform(wanted, lambda c: clean_constraint(c, most)), lambda c: c != ""))
    title = clean_constraint(F.coalesce(F.nullif(product["title"], F.lit("")), F.lit("product")), most)
    constraints = once(clean, lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(title)))
    card = lambda c: F.struct(
        title.alias("target_category"),
        F.slice(c, 1, 2).alias("hard_constraints"),
        F.when(F.size(c) > 2, F.slice(c, 3, 2)).otherwise(F.slice(c, 1, 1)).alias("soft_preferences"),
    )
    return once(constraints, card)


def opening(scenario: Column, category: Column, hard: Column, old_value: Column) -> Column:
    """A simulated shopper's first message."""
    start = F.concat(F.lit("I'm looking for "), category)
    return (
        F.when((scenario == "buying") & (F.size(hard) > 0), F.concat(start, F.lit(". A key requirement is: "), F.get(hard, F.lit(0)), F.lit(".")))
        .when(scenario == "intent_override", F.concat(start, F.lit(". "), old_value))
        .otherwise(F.concat(start, F.lit(", but I'm still exploring.")))
    )


def answer(ask: Column, ranked: Column) -> Column:
    """The agent's message: a question, or else its picks (ranked: whether it has any)."""
    return (
        F.when(ask.isNotNull(), F.concat(F.lit("Here are some options. Could you tell me your preference for "), ask, F.lit("?")))
        .when(ranked, F.lit("Here are my top picks based on your request."))
        .otherwise(F.lit("I couldn't find a match. Could you describe what you're looking for?"))
    )
