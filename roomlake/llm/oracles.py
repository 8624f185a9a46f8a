"""SQL for the queries that DuckDB can express."""

from __future__ import annotations

from roomlake.llm import chat, lines, mixing, queries

BASE32 = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', {five}::INT + 1, 1)"


def base32(hexadecimal: str) -> str:
    """Base32 of 40 hexadecimal digits: eight runs of five digits, each four letters."""
    run = f"('0x' || substr({hexadecimal}, k * 5 + 1, 5))::BIGINT"
    letters = " || ".join(BASE32.format(five=f"({run} // {1 << shift} % 32)") for shift in (15, 10, 5, 0))
    return f"array_to_string(list_transform(range(8), lambda k: {letters}), '')"


OP1 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), w AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, {base32("h")} AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN w USING (h)"""


def _escape_sql(text: str, template: chat.ChatTemplate) -> str:
    head, rest = template._parts
    return rf"regexp_replace({text}, '{head}(\\*){rest}', '\1\\\2\3', 'g')"


def op2(template: chat.ChatTemplate = chat.ChatTemplate()) -> str:
    """Formatted length: the escaped texts, and the markers of blocks and of merged turns between them."""
    marks = len(template.open) + 1 + len(template.close)
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, length({_escape_sql("text", template)}) AS chars, coalesce(lag(role) OVER w <> role, true) AS opens FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
sum(chars + CASE WHEN opens THEN {marks} + length(role) ELSE {len(template.more)} END)::BIGINT AS formatted_chars FROM n GROUP BY conv_id"""


def op5(plan: mixing.MixPlan) -> str:
    """The same shares and prefixes, with every leaf put in order as a whole."""
    number = r"TRY_CAST(regexp_extract(source, '(\d+)$', 1) AS INT)"
    words = r"length(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g')) - length(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', '', 'g'))"
    steps = [
        f"d AS (SELECT doc_id, lang AS lang0, source AS source0, coalesce('domain' || ({number} % 4), 'unknown') AS domain, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, ({words})::HUGEINT AS tokens FROM documents)",
        f"leaves AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS tokens, (sum(tokens) * {plan.max_epochs})::HUGEINT AS capacity FROM d GROUP BY ALL)",
        f"b0 AS (SELECT least(coalesce(sum(tokens), 0)::HUGEINT * {plan.budget_percent} // 100, coalesce(sum(capacity), 0)::HUGEINT) AS budget FROM leaves)",
    ]
    for depth in range(1, len(plan.levels) + 1):
        above, own = list(plan.levels[: depth - 1]), list(plan.levels[:depth])
        label = f"'{'*/' if depth > 1 else ''}' || {own[-1]}"
        path = " || '/' || ".join(own)
        listed = {k: v for k, v in plan.weights.items() if k.count("/") == depth - 1 or k.startswith("*/") and depth > 1}
        cases = lambda of: f"CASE {of} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in listed.items()) + " END" if listed else "NULL"  # noqa: B023, E731
        over = f"PARTITION BY {', '.join(above)}" if above else ""
        on = f"USING ({', '.join(above)})" if above else "ON true"
        steps += [
            f"n{depth} AS (SELECT {', '.join(own)}, capacity, weight FROM (SELECT {', '.join(own)}, coalesce({cases(path)}, {cases(label)}, {plan.default_weight})::HUGEINT AS weight, sum(capacity)::HUGEINT AS c FROM leaves GROUP BY {', '.join(own)}) t, LATERAL (SELECT CASE WHEN weight > 0 THEN c ELSE 0 END AS capacity))",
            f"r{depth} AS (SELECT *, coalesce(capacity::DOUBLE / nullif(weight, 0)::DOUBLE, 0) AS ratio FROM n{depth} JOIN b{depth - 1} {on})",
            f"u{depth} AS (SELECT *, sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - capacity AS used, sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_on FROM r{depth} WINDOW w AS ({over} ORDER BY ratio, {own[-1]}))",
            f"f{depth} AS (SELECT *, weight = 0 OR capacity * weights_on + used * weight <= budget * weight AS is_full FROM u{depth})",
            f"o{depth} AS (SELECT *, budget - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({over}) AS rest, CASE WHEN is_full THEN 0 ELSE weight END AS open_ FROM f{depth})",
            f"s{depth} AS (SELECT *, sum(open_) OVER ({over}) AS all_open, sum(open_) OVER ({over} ORDER BY {own[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM o{depth})",
            f"b{depth} AS (SELECT {', '.join(own)}, (CASE WHEN is_full THEN capacity ELSE rest * upto // nullif(all_open, 0) - rest * (upto - open_) // nullif(all_open, 0) END)::HUGEINT AS budget FROM s{depth})",
        ]
    levels = ", ".join(plan.levels)
    steps += [
        f"cut AS (SELECT {levels}, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM leaves JOIN b{len(plan.levels)} USING ({levels}))",
        f"h AS (SELECT d.*, whole, rest, md5('{plan.seed}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')) AS order_hash FROM d JOIN cut USING ({levels}))",
        f"g AS (SELECT {levels}, order_hash, doc_id, sum(tokens) AS here FROM h GROUP BY ALL)",
        f"running AS (SELECT {levels}, order_hash, doc_id, sum(here) OVER (PARTITION BY {levels} ORDER BY order_hash, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - here AS used FROM g)",
        f"taken AS (SELECT h.*, whole + CASE WHEN used < rest THEN 1 ELSE 0 END AS times FROM h JOIN running r USING ({levels}, order_hash) WHERE h.doc_id IS NOT DISTINCT FROM r.doc_id)",
    ]
    return f"WITH {', '.join(steps)} SELECT doc_id, domain, lang0 AS lang, source0 AS source, unnest(range(times::BIGINT)) AS epoch FROM taken"


OP7 = rf"""WITH l AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
e AS (SELECT DISTINCT doc_id, source, unnest(parts) AS line FROM l), n AS (SELECT source, line, count(*) AS pages FROM e WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
t AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
bad AS (SELECT source, list(line) AS lines FROM n JOIN t USING (source) WHERE pages >= {lines.AT_LEAST} AND pages > {lines.RATIO}::DOUBLE * host_pages GROUP BY source),
k AS (SELECT l.*, list_filter(parts, lambda x: NOT list_contains(coalesce(lines, []), x)) AS kept FROM l LEFT JOIN bad USING (source))
SELECT doc_id, source, coalesce(array_to_string(kept, chr(10)), text) AS text, coalesce(len(parts), 0)::INT AS n_lines, coalesce(len(parts) - len(kept), 0)::INT AS n_dropped FROM k"""

ORACLES: dict[str, str] = {"op1_warc_revisit": OP1, "op2_chat_format": op2(), "op5_source_mix": op5(queries.MIX), "op7_line_dedup": OP7}
