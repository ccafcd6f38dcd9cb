"""DuckDB SQL fragments used by the oracle queries (independent re-statement
of the column expressions in ``tessera.functions.text``)."""

# The same white-space class and end-of-text marker as the Spark side.
WS = r"[\t\n\x0B\f\r ]"
EOT = "<|endoftext|>"


def norm(t: str) -> str:
    """B1 in DuckDB SQL."""
    return f"replace(trim(regexp_replace({t}, '{WS}+', ' ', 'g')), '{EOT}', ' ')"


def ws_toks(t: str, lower: bool = True) -> str:
    """B5 in DuckDB SQL (empty list for blank text)."""
    x = f"lower({t})" if lower else t
    s = f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"
    return f"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE string_split({s}, ' ') END)"


def doc_tokens(table: str = "documents", text: str = "text", extra: str = "") -> str:
    """SELECT producing (doc_id, tokens) after B1 + B5 + C8."""
    return (f"SELECT doc_id{extra}, {ws_toks(norm(text))} AS tokens FROM {table} "
            f"WHERE len({ws_toks(norm(text))}) >= 2")


def occurrences(resolutions=(1, 2, 3, 5, 8), table: str = "documents", extra: str = "") -> str:
    vals = ",".join(f"({r})" for r in resolutions)
    return f"""
    (SELECT p.doc_id{extra}, p.position, r.resolution,
            array_to_string(p.tokens[p.position + 1 : p.position + r.resolution], ' ') AS pattern,
            p.tokens[p.position + r.resolution + 1] AS next
     FROM (SELECT *, unnest(range(len(tokens))) AS position FROM ({doc_tokens(table, extra=extra)})) p
     JOIN (VALUES {vals}) r(resolution) ON p.position + r.resolution < len(p.tokens))"""
