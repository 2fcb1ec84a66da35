"""Pieces of oracle SQL used by several queries."""

NAME_DROP = "[\\s　‐‑‒–—―ー・_/.\\-]"


def name_key(x: str) -> str:
    return f"lower(regexp_replace(coalesce({x},''),'{NAME_DROP}','','g'))"


def code_lower(x: str) -> str:
    return f"lower(regexp_replace({x},'[^a-zA-Z0-9]','','g'))"


def code_upper(x: str) -> str:
    return f"nullif(regexp_replace(upper(trim({x})),'[^A-Z0-9]','','g'),'')"


def trigrams(x: str) -> str:
    return (
        f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(coalesce({x},'')),"
        f"'[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w)+2), "
        f"lambda i: substr('  ' || w || ' ', i, 3)))))"
    )


def similarity(a: str, b: str) -> str:
    x, y = trigrams(a), trigrams(b)
    return (
        f"(case when len(list_distinct(list_concat({x},{y})))=0 then 0.0 else "
        f"len(list_intersect({x},{y}))*1.0/len(list_distinct(list_concat({x},{y}))) end)"
    )
