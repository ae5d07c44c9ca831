"""A small invented knowledge base for the named queries, as rows and as SQL."""

from __future__ import annotations

# (ord, key, ruling, school, verses, narrations, keywords, reasoning, confidence)
RULES = [
    (0, "und", "allowed", "north", ["v1", "v2"], ["n1"], ["und der", "die"], "first reason", "high"),
    (1, "thand", "not allowed", "north", ["v2", "v9"], ["n2", "n3"], ["thand", "the thing"], "second reason", "medium"),
    (2, "ouran", "doubtful", "south", [], ["n4"], ["ouran", "que la", "la le"], "third reason", "medium"),
    (3, "losra", "allowed", "south", ["v3", "v1", "v4"], ["n1", "n5"], ["losra", "que de los", "para"], "fourth reason", "high"),
    (4, "ionth", "advised", "north", ["v4"], [], ["that is", "onth", "of the"], "fifth reason", "low"),
]
RULES_SCHEMA = "ord int, key string, ruling string, school string, basis_verses array<string>, basis_narrations array<string>, keywords array<string>, reasoning string, confidence string"
# (ord, key, reference, arabic_text, transliteration, translation, theme)
VERSES = [(i, f"v{i + 1}", f"{i + 1}:{7 * i + 1}", f"text {i}", None, f"translation {i}", theme) for i, theme in enumerate(["water", "road", "water", "bread"])]
CACHED_VERSES = [(i, f"v{i + 9}", f"{i + 9}:1", f"cached {i}", None, None, theme) for i, theme in enumerate(["road and rest", "the thing", "das ist", "la ruta"])]
VERSES_SCHEMA = "ord int, key string, reference string, arabic_text string, transliteration string, translation string, theme string"
# (ord, key, source, arabic_text, authenticity)
NARRATIONS = [(i, f"n{i + 1}", f"Book no. {i + 1}", f"words {i}", a) for i, a in enumerate(["sahih", "hasan", "dhaif", "sahih"])]
CACHED_NARRATIONS = [(0, "n5", "Cache no. 5", "words", "hasan"), (1, "n6", "Cache no. 6", "words", "sahih")]
NARRATIONS_SCHEMA = "ord int, key string, source string, arabic_text string, authenticity string"


def sql_value(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, (list, tuple)):
        return f"[{', '.join(map(sql_value, x))}]" + ("::VARCHAR[]" if not x else "")
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def sql_rows(name: str, columns: str, rows: list) -> str:
    """A common table expression of literal rows."""
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(sql_value, r)) + ')' for r in rows)})"


def columns(schema: str) -> str:
    return ", ".join(c.split()[0] for c in schema.split(", "))
