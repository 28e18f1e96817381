"""SQL of the conversation repair: the programme as a fold over a conversation's rows."""

from __future__ import annotations


def _added(state: str, cost, letter: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}'}}"


def _least(*offers: str) -> str:
    return "list_sort([" + ", ".join(offers) + "])[1]"


def _inserted(v: str) -> str:
    """States after insertions: user from nothing, system and assistant; then assistant from user."""
    user = _least(f"{v}[3]", *[_added(f"{v}[{i}]", 3, "I") for i in (1, 2, 4)])
    assistant = _least(f"{v}[4]", _added("w", 3, "I"))
    return f"list_transform([{user}], lambda w: [{v}[1], {v}[2], w, {assistant}])[1]"


def _kept(role: str) -> str:
    return f"(CASE WHEN lower(x.s) = '{role}' THEN x.e ELSE 1000000000 END)"


_REROLED = "(CASE WHEN x.s <> 'D' THEN 3 + x.e ELSE 1000000000 END)"
_START = ", ".join(f"{{'c': {c}::BIGINT, 'a': ''}}" for c in (0, 1_000_000_000, 1_000_000_000, 1_000_000_000))


def _step() -> str:
    new = [
        _added("q[1]", 4, "D"),
        _least(_added("q[2]", 4, "D"), _added("q[1]", _kept("s"), "K")),
        _least(
            _added("q[3]", 4, "D"),
            *[_added(f"q[{i}]", _kept("u"), "K") for i in (1, 2, 4)],
            *[_added(f"q[{i}]", _REROLED, "R") for i in (1, 2, 4)],
        ),
        _least(_added("q[4]", 4, "D"), _added("q[3]", _kept("a"), "K"), _added("q[3]", _REROLED, "R")),
    ]
    return f"list_transform([{_inserted('acc.v')}], lambda q: [{', '.join(new)}])[1]"


REPAIR_SQL = f"""
    WITH o AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(
            list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT),
            lambda c, b: list_reduce(range(8), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(c, b)),
            4294967295), 4294967295) % 20 AS lot
        FROM conversations
    ), d AS (
        SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
               CASE lot WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
               unnest(range(CASE lot WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
        FROM o
    ), n AS (
        SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, row_number() OVER (
            PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), copy) AS i
        FROM d
    ), f AS (
        SELECT *, CASE WHEN body = '' THEN 'blank'
                       WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                       WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS mark,
               lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS role_before
        FROM n
    ), g AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
               count(*) FILTER (WHERE mark = 'blank') AS blank, count(*) FILTER (WHERE mark = 'duplicate') AS duplicate,
               count(*) FILTER (WHERE mark = 'truncated') AS truncated,
               count(*) FILTER (WHERE role_before IS NOT NULL AND left(role_before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
               list_reduce(list({{'s': CASE WHEN mark IN ('blank', 'duplicate') THEN 'D' WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END,
                                 'e': CASE WHEN mark = 'truncated' THEN 3 ELSE 0 END, 'v': [{_START}]}} ORDER BY i),
                   lambda acc, x: {{'s': '', 'e': 0, 'v': {_step()}}}, {{'s': '', 'e': 0, 'v': [{_START}]}}).v AS v
        FROM f GROUP BY conv_id
    ), b AS (
        SELECT * EXCLUDE (v), list_transform([{_inserted('v')}], lambda q: {_least('q[1]', 'q[4]')})[1] AS best FROM g
    ), l AS (
        SELECT conv_id, unnest(range(1, length(best.a) + 1)) AS j, best.a AS a FROM b
    ), p AS (
        SELECT conv_id, j, a[j] AS edit, length(replace(a[1:j], 'I', '')) AS i, length(replace(a[1:j], 'D', '')) AS k FROM l
    ), m AS (
        SELECT p.*, f.role, f.text, bool_or(k = 1 AND edit = 'K' AND left(f.role, 1) = 's') OVER (PARTITION BY p.conv_id) AS system
        FROM p LEFT JOIN f ON edit <> 'I' AND f.i = p.i AND f.conv_id IS NOT DISTINCT FROM p.conv_id
    ), t AS (
        SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (k - system::INTEGER) % 2 = 1 THEN 'user' ELSE 'assistant' END
            || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS whole
        FROM m WHERE edit <> 'D' GROUP BY conv_id
    ), c AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
           coalesce(best.a, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
    FROM c LEFT JOIN b ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN t ON c.conv_id IS NOT DISTINCT FROM t.conv_id
"""
