"""Independent DuckDB SQL for each registered query (the correctness oracle).

These are written separately from the Spark code, as plain row-at-a-time SQL
(window functions, list lambdas), over the same adapter views.  Where the
general parser is long (RFC 2047, quoted CSV), the SQL covers the value shapes
the adapter views produce; the unit tests cover the general vectors.
"""

from __future__ import annotations

from ..sources.adapters import view_sql

ADDR_RE = (r"[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+(?:\.[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+)*"
           r"@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
B_WORD = r"=\?utf-8\?B\?([A-Za-z0-9+/=]+)\?="


def d_decode(x: str) -> str:
    return (f"(CASE WHEN regexp_full_match({x}, '{B_WORD}') "
            f"THEN decode(from_base64(regexp_extract({x}, '{B_WORD}', 1))) ELSE {x} END)")


def d_sender(f: str) -> str:
    a0 = f"trim({f})"
    a = f"(CASE WHEN strpos({a0}, '<') = 0 THEN {d_decode(a0)} ELSE {a0} END)"
    disp = f"trim(regexp_extract({a}, '^(.*?)<([^<>]+)>$', 1))"
    addr = (f"(CASE WHEN strpos({a}, '<') > 0 THEN trim(regexp_extract({a}, '^(.*?)<([^<>]+)>$', 2)) "
            f"ELSE {a} END)")
    refused = (f"({disp} <> '' AND strpos({disp}, '=?') = 0 "
               f"AND NOT regexp_full_match({disp}, '\"(?:[^\"\\\\\\r\\n]|\\\\[^\\r\\n])*\"') "
               f"AND regexp_matches({disp}, '[\",;<>@:\\\\]'))")
    return (f"(CASE WHEN {f} IS NULL THEN NULL "
            f"WHEN strpos({a}, '<') > 0 AND NOT regexp_full_match({a}, '(.*?)<([^<>]+)>') THEN NULL "
            f"WHEN strpos({a}, '<') > 0 AND {refused} THEN NULL "
            f"WHEN length({addr}) <= 254 AND regexp_full_match({addr}, '{ADDR_RE}') THEN lower({addr}) END)")


def d_labels(v: str) -> str:
    """Label list for the value shapes of ``v_msgs`` (NULL when a quote is unterminated)."""
    unq = (f"trim(replace(regexp_replace(p, '\"((?:[^\"]|\"\")*)\"', '\\1', 'g'), '\"\"', '\"'))")
    return (f"(CASE WHEN {v} IS NULL THEN []::VARCHAR[] "
            f"WHEN (length({v}) - length(replace({v}, '\"', ''))) % 2 = 1 THEN NULL "
            f"ELSE list_transform(list_filter(list_transform("
            f"regexp_extract_all({v}, '(?:[^\",]|\"(?:[^\"]|\"\")*\")+'), lambda p: {unq}), lambda t: t <> ''), "
            f"lambda t: {d_decode('t')}) END)")


def facts_cte() -> str:
    """DuckDB CTEs ``v_msgs`` and ``facts`` (per-message parsed facts)."""
    return f"""
v_msgs AS ({view_sql('v_msgs')}),
m1 AS (
  SELECT *, {d_labels('label1')} AS l1, {d_labels('label2')} AS l2,
         {d_sender('from1')} AS p1, {d_sender('from2')} AS p2,
         list_filter([id1, id2], lambda x: x IS NOT NULL) AS ids
  FROM v_msgs),
m2 AS (
  SELECT *, list_concat(coalesce(l1, []::VARCHAR[]), coalesce(l2, []::VARCHAR[])) AS labels_all,
         (CASE WHEN label1 IS NOT NULL AND l1 IS NULL THEN 1 ELSE 0 END
          + CASE WHEN label2 IS NOT NULL AND l2 IS NULL THEN 1 ELSE 0 END) AS unterm,
         (CASE WHEN from1 IS NOT NULL AND p1 IS NULL THEN 1 ELSE 0 END
          + CASE WHEN from2 IS NOT NULL AND p2 IS NULL THEN 1 ELSE 0 END) AS bad_from,
         CASE WHEN len(ids) = 1 AND regexp_full_match(trim(ids[1]), '<[^<>\\s]+@[^<>\\s]+>')
              THEN trim(ids[1]) END AS mid
  FROM m1),
facts AS (
  SELECT mailbox_id, file_seq, msg_seq, header_valid,
         CASE WHEN header_valid THEN labels_all ELSE []::VARCHAR[] END AS labels,
         CASE WHEN header_valid THEN unterm ELSE 0 END AS unterminated_labels,
         CASE WHEN header_valid THEN mid END AS message_id,
         CASE WHEN header_valid AND from2 IS NULL THEN p1 END AS email,
         CASE WHEN header_valid THEN bad_from ELSE 0 END AS invalid_from,
         header_valid AND (sent_hint OR len(list_filter(labels_all, lambda x: lower(x) IN
           ('sent', 'sent mail', 'sent messages', '[gmail]/sent mail', '\\sent', '已发送', '已发送邮件',
            '已寄出', '已寄出的郵件', '寄件備份'))) > 0) AS is_sent
  FROM m2),
efacts AS (SELECT *, is_sent AND email IS NOT NULL AS eligible FROM facts)"""


def mailbox_queries() -> dict[str, str]:
    f = "WITH " + facts_cte()
    q: dict[str, str] = {}
    q["message_id"] = f + """
SELECT mailbox_id, file_seq, msg_seq, message_id FROM efacts"""
    q["sender_normalize"] = f + """
SELECT mailbox_id, msg_seq, 0 AS pos, p1 AS email FROM m1 WHERE from1 IS NOT NULL
UNION ALL SELECT mailbox_id, msg_seq, CASE WHEN from1 IS NULL THEN 0 ELSE 1 END, p2 FROM m1 WHERE from2 IS NOT NULL"""
    from .. import constants as K
    q["label_split"] = f + """
SELECT mailbox_id, file_seq, msg_seq, CAST(u.pos - 1 AS INTEGER) AS pos, u.label
FROM efacts, LATERAL (SELECT unnest(labels) AS label, generate_subscripts(labels, 1) AS pos) u"""
    q["sent_messages"] = f + """
SELECT mailbox_id, file_seq, msg_seq, email, message_id FROM efacts WHERE is_sent"""
    q["sender_candidates"] = f + """,
firsts AS (
  SELECT mailbox_id, email,
         row_number() OVER (PARTITION BY mailbox_id, message_id ORDER BY file_seq, msg_seq) AS rn
  FROM efacts WHERE eligible AND message_id IS NOT NULL)
SELECT mailbox_id, email, count(*) AS messages FROM (
  SELECT mailbox_id, email FROM firsts WHERE rn = 1
  UNION ALL SELECT mailbox_id, email FROM efacts WHERE eligible AND message_id IS NULL) s
GROUP BY mailbox_id, email"""
    q["top_senders"] = q["sender_candidates"].replace(
        "SELECT mailbox_id, email, count(*) AS messages FROM (",
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mailbox_id ORDER BY messages DESC, email) AS rank "
        "FROM (SELECT mailbox_id, email, count(*) AS messages FROM (", 1,
    ) + ") c) r WHERE rank <= 3"
    q["sender_ranking"] = q["sender_candidates"]
    per_row = f + """,
idrows AS (
  SELECT *, row_number() OVER (PARTITION BY mailbox_id, file_seq, message_id ORDER BY msg_seq) AS local_rn,
         min(CASE WHEN eligible THEN file_seq END) OVER (PARTITION BY mailbox_id, message_id) AS first_file
  FROM efacts WHERE message_id IS NOT NULL),
dups AS (
  SELECT mailbox_id, file_seq,
         CAST(count_if(local_rn > 1) AS BIGINT) AS duplicate_count,
         CAST(count_if(local_rn = 1 AND eligible AND first_file < file_seq) AS BIGINT) AS cross_file_duplicates
  FROM idrows GROUP BY mailbox_id, file_seq)"""
    q["duplicate_counts"] = per_row + """
SELECT * FROM dups"""
    q["mailbox_stats"] = per_row + """
SELECT b.mailbox_id, b.file_seq, b.message_count, b.invalid_headers,
       coalesce(d.duplicate_count, 0) AS duplicate_count,
       coalesce(d.cross_file_duplicates, 0) AS cross_file_duplicates,
       b.invalid_from, b.unterminated_labels, b.sent_without_from
FROM (SELECT mailbox_id, file_seq, count(*) AS message_count,
             CAST(count_if(NOT header_valid) AS BIGINT) AS invalid_headers,
             CAST(sum(invalid_from) AS BIGINT) AS invalid_from,
             CAST(sum(unterminated_labels) AS BIGINT) AS unterminated_labels,
             CAST(count_if(is_sent AND email IS NULL) AS BIGINT) AS sent_without_from
      FROM efacts GROUP BY mailbox_id, file_seq) b
LEFT JOIN dups d USING (mailbox_id, file_seq)"""
    told = {"malformed_headers": ("invalid_headers", K.W_MALFORMED), "unterminated_label": ("unterminated_labels", K.W_UNTERMINATED_LABEL),
            "sent_without_from": ("sent_without_from", K.W_SENT_NO_FROM), "local_duplicates": ("duplicate_count", K.W_LOCAL_DUPES_SHARED),
            "cross_file_duplicates": ("cross_file_duplicates", K.W_CROSS_DUPES), "invalid_from": ("invalid_from", K.W_INVALID_FROM)}
    q["warning_summary"] = "WITH stats AS (" + q["mailbox_stats"] + ")\n" + "\nUNION ALL ".join(
        f"SELECT mailbox_id, file_seq, '{code}' AS code, {c} AS n, replace('{t}', '{{n}}', {c}::VARCHAR) AS text FROM stats WHERE {c} > 0" for code, (c, t) in told.items())
    q["stream_senders"] = q["incremental_senders"] = q["sender_candidates"]
    q["stream_dedup"] = f + """
SELECT mailbox_id, message_id, email FROM (
  SELECT *, row_number() OVER (PARTITION BY mailbox_id, message_id ORDER BY file_seq, msg_seq) AS rn
  FROM efacts WHERE eligible AND message_id IS NOT NULL) s WHERE rn = 1"""
    q["label_inventory"] = f + """
SELECT DISTINCT mailbox_id, unnest(labels) AS label FROM efacts"""
    q["invalid_from"] = f + """
SELECT mailbox_id, CAST(sum(invalid_from) AS BIGINT) AS invalid_from FROM efacts GROUP BY mailbox_id"""
    return q


def search_cte(source: str) -> str:
    """The CTEs that parse the searches (query_id, text) of a source."""
    from .. import constants as K

    return f"""
WITH v_searches AS ({source}),
g AS (
  SELECT query_id, text,
    list_filter([
      CASE WHEN length(text) > 4096 THEN '{K.Q_TOO_LONG}' END,
      CASE WHEN regexp_matches(text, '[\\x00-\\x1f\\x7f-\\x{{9f}}\\x{{2028}}\\x{{2029}}]') THEN '{K.Q_CONTROL}' END,
      CASE WHEN trim(text) = '' THEN '{K.Q_EMPTY}' END], lambda x: x IS NOT NULL) AS gates
  FROM v_searches),
s AS (
  SELECT *,
    CASE WHEN len(gates) = 0 THEN regexp_extract_all(text, '(?:[^"\\s]|"(?:\\\\(?s:.)|[^"\\\\])*(?:"|$))+') END AS tokens,
    len(list_filter(flatten(list_transform(
        list_filter(regexp_extract_all(text, '"(?:\\\\(?s:.)?|[^"\\\\])*"?|[^"]+'), lambda x: x[1] = '"'),
        lambda sp: regexp_extract_all(sp, '\\\\(?s:.)?'))), lambda p: p NOT IN ('\\"', '\\\\'))) AS bad_esc,
    regexp_full_match(text, '(?s)(?:[^"]|"(?:\\\\.|[^"\\\\])*")*') AS terminated
  FROM g),
p1 AS (
  SELECT *, CASE WHEN len(gates) > 0 THEN gates ELSE list_concat(
      list_transform(range(bad_esc), lambda i: '{K.Q_ESCAPE}'),
      list_filter(['{K.Q_UNCLOSED}', '{K.Q_TOO_MANY}'], lambda r:
        (r = '{K.Q_UNCLOSED}' AND NOT terminated) OR (r = '{K.Q_TOO_MANY}' AND len(tokens) > 20))) END AS phase1
  FROM s),
tok AS (
  SELECT query_id, raw, pos FROM (
    SELECT query_id, unnest(tokens) AS raw, generate_subscripts(tokens, 1) - 1 AS pos FROM p1 WHERE len(phase1) = 0)),
t1 AS (
  SELECT *, starts_with(raw, '-') AS neg,
         CASE WHEN starts_with(raw, '-') THEN substr(raw, 2) ELSE raw END AS txt FROM tok),
t2 AS (
  SELECT *, CASE WHEN regexp_matches(txt, '^[a-zA-Z_]+:') THEN lower(regexp_extract(txt, '^([a-zA-Z_]+):', 1)) ELSE '' END AS key,
         CASE WHEN regexp_matches(txt, '^[a-zA-Z_]+:') THEN regexp_replace(txt, '^[a-zA-Z_]+:', '') ELSE txt END AS rest
  FROM t1),
t3 AS (
  SELECT *, starts_with(rest, '"') AS quoted,
    CASE WHEN starts_with(rest, '"') THEN regexp_replace(substr(rest, 2, length(rest) - 2), '\\\\(["\\\\])', '\\1', 'g') ELSE rest END AS lit
  FROM t2),
t4 AS (
  SELECT *, TRY_CAST(regexp_extract(lit, '(?i)^(\\d+)([KMG]?)$', 1) AS DECIMAL(38,0))
      * CASE upper(regexp_extract(lit, '(?i)^(\\d+)([KMG]?)$', 2)) WHEN 'K' THEN 1024 WHEN 'M' THEN 1048576
                                                                  WHEN 'G' THEN 1073741824 ELSE 1 END AS amount
  FROM t3),
t5 AS (
  SELECT *, CASE
    WHEN raw = 'OR' THEN '{K.Q_OR}'
    WHEN txt = '' OR starts_with(txt, '-') THEN raw || '：' || '{K.Q_MINUS}'
    WHEN regexp_matches(txt, '[{{}}]') THEN raw || '：' || '{K.Q_BRACES}'
    WHEN regexp_matches(txt, '[()*?]') THEN raw || '：' || '{K.Q_PARENS}'
    WHEN quoted AND NOT regexp_full_match(rest, '"(?:[^"\\\\]|\\\\["\\\\])*"') THEN raw || '：' || '{K.Q_QUOTE_SHAPE}'
    WHEN NOT quoted AND regexp_matches(rest, '["\\\\]') THEN raw || '：' || '{K.Q_BARE_QUOTE}'
    WHEN trim(lit) = '' THEN raw || '：' || '{K.Q_BLANK}'
    WHEN strpos(lit, ':') > 0 THEN raw || '：' || '{K.Q_COLON}'
    WHEN lit IN ('AND', 'OR', 'NOT') OR regexp_matches(lit, '(?:^|\\s)(?:AND|OR|NOT)(?:\\s|$)') OR starts_with(lit, '-')
      THEN raw || '：' || '{K.Q_NESTED}'
    WHEN key IN ('from', 'to', 'cc') AND strpos(lit, '@') > 0 AND NOT regexp_full_match(lit,
      '(?i)[a-z0-9!#$%&''+/=?^_`~-]+(?:\\.[a-z0-9!#$%&''+/=?^_`~-]+)*@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\\.)+[a-z0-9](?:[a-z0-9-]*[a-z0-9])?')
      THEN raw || '：' || '{K.Q_ADDRESS}'
    WHEN key IN ('larger', 'smaller', 'size') AND NOT regexp_full_match(lit, '(?i)\\d+[KMG]?') THEN raw || '：' || '{K.Q_SIZE_SHAPE}'
    WHEN key IN ('larger', 'smaller', 'size') AND (amount IS NULL OR amount > 4294967295) THEN raw || '：' || '{K.Q_SIZE_RANGE}'
    WHEN key = 'has' AND lit <> 'attachment' THEN raw || '：' || '{K.Q_HAS}'
    WHEN key <> '' AND key NOT IN ('from', 'to', 'cc', 'larger', 'smaller', 'size', 'has', 'subject')
      THEN raw || '：' || replace('{K.Q_KEY}', '{{key}}', key)
    END AS reason,
    CASE WHEN key IN ('larger', 'smaller', 'size') THEN 'size' WHEN key = 'has' THEN 'attachment'
         WHEN key = '' THEN 'body' ELSE key END AS field,
    CASE WHEN key IN ('from', 'to', 'cc') AND strpos(lit, '@') > 0 THEN 'is' WHEN key = 'smaller' THEN 'under'
         WHEN key IN ('larger', 'size') THEN 'over' WHEN key = 'has' THEN 'is' ELSE 'contains' END AS op,
    CASE WHEN key IN ('larger', 'smaller', 'size') THEN CAST(amount AS BIGINT) END AS num
  FROM t4),
t6 AS (
  SELECT *, CASE WHEN key IN ('from', 'to', 'cc') AND strpos(lit, '@') > 0 THEN lower(lit)
                 WHEN key IN ('larger', 'smaller', 'size') THEN CAST(num AS VARCHAR)
                 WHEN key = 'has' THEN 'attachment' ELSE lit END AS value
  FROM t5),
ok AS (SELECT * FROM t6 WHERE reason IS NULL),
ok2 AS (
  SELECT *,
    min(CASE WHEN neg THEN pos END) OVER (PARTITION BY query_id, field, op, value) AS first_neg,
    min(CASE WHEN NOT neg THEN pos END) OVER (PARTITION BY query_id, field, op, value) AS first_pos,
    min(value) OVER w AS prev_min, max(value) OVER w AS prev_max
  FROM ok
  WINDOW w AS (PARTITION BY query_id, neg, field, op ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
reasons AS (
  SELECT query_id, 0 AS grp, pos AS k1, 0 AS k2, reason AS r FROM t6 WHERE reason IS NOT NULL
  UNION ALL
  SELECT query_id, 1, pos, 0, raw || '：' || '{K.Q_BOTH_POLARITIES}' FROM ok2
    WHERE (CASE WHEN neg THEN first_pos ELSE first_neg END) < pos
  UNION ALL
  SELECT query_id, 1, pos, 1, raw || '：' || '{K.Q_CONFLICT}' FROM ok2
    WHERE (op = 'is' OR field = 'size') AND (prev_min <> value OR prev_max <> value)
  UNION ALL
  SELECT query_id, 2, CASE WHEN neg THEN 1 ELSE 0 END, 0, '{K.Q_SIZE_CONFLICT}' FROM (
    SELECT query_id, neg,
      arg_min(num, pos) FILTER (WHERE field = 'size' AND op = 'over') AS o,
      arg_min(num, pos) FILTER (WHERE field = 'size' AND op = 'under') AS u
    FROM ok GROUP BY query_id, neg) z WHERE o >= u),
unsup AS (
  SELECT query_id, string_agg(r, ' | ' ORDER BY grp, k1, k2) AS reasons FROM reasons GROUP BY query_id),
res AS (
  SELECT p1.query_id, p1.phase1, p1.tokens, p1.gates,
         CASE WHEN len(p1.phase1) > 0 THEN array_to_string(p1.phase1, ' | ') ELSE coalesce(u.reasons, '') END AS unsupported_text
  FROM p1 LEFT JOIN unsup u USING (query_id)),
tests AS (
  SELECT ok.* FROM ok JOIN res USING (query_id) WHERE res.unsupported_text = '')"""


def search_queries() -> dict[str, str]:
    from .. import constants as K

    base = search_cte(view_sql('v_searches'))
    q: dict[str, str] = {}
    q["query_gates"] = base + "\nSELECT query_id, array_to_string(gates, ' | ') AS gates FROM res"
    q["query_tokens"] = base + """
SELECT query_id, CAST(pos AS INTEGER) AS pos, token FROM (
  SELECT query_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM res WHERE tokens IS NOT NULL)"""
    q["query_parse"] = base + """
SELECT res.query_id,
  (SELECT count(*) FROM tests t WHERE t.query_id = res.query_id AND NOT t.neg) AS n_tests,
  (SELECT count(*) FROM tests t WHERE t.query_id = res.query_id AND t.neg) AS n_negated,
  coalesce((SELECT string_agg(field || '|' || op || '|' || value || '|' || raw, ' ; ' ORDER BY pos)
            FROM tests t WHERE t.query_id = res.query_id AND NOT t.neg), '') AS tests_text,
  coalesce((SELECT string_agg(field || '|' || op || '|' || value || '|' || raw, ' ; ' ORDER BY pos)
            FROM tests t WHERE t.query_id = res.query_id AND t.neg), '') AS negated_text,
  unsupported_text
FROM res"""
    q["query_tests"] = base + """
SELECT query_id, neg AS negated,
  CAST(row_number() OVER (PARTITION BY query_id, neg ORDER BY pos) - 1 AS INTEGER) AS pos,
  field, op, value, num, raw
FROM tests"""
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.FIELD_NAMES.items())
    ops = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.OP_WORDS.items())
    q["query_describe"] = base + f"""
SELECT query_id, string_agg(CASE WHEN field = 'attachment' THEN '{K.ATTACHMENT_WORD}' ELSE
    (CASE field {names} ELSE field END) || (CASE op {ops} END)
    || (CASE WHEN field = 'size' THEN value || '{K.BYTES_SUFFIX}' ELSE to_json(value)::VARCHAR END) END,
  '{K.DESCRIBE_JOIN}' ORDER BY pos) AS description
FROM tests WHERE NOT neg GROUP BY query_id
UNION ALL
SELECT query_id, '' AS description FROM res
WHERE query_id NOT IN (SELECT query_id FROM tests WHERE NOT neg)"""
    return q


def rule_queries() -> dict[str, str]:
    from .. import constants as K

    props = K.CRITERIA + K.ACTIONS
    ctrl = "[\\x00-\\x1f\\x7f-\\x{9f}\\x{2028}\\x{2029}]"

    def active(n: str) -> str:
        v = f"p_{n}"
        cond = f"{v} IS NOT NULL AND NOT regexp_matches({v}, '{ctrl}') AND {v} <> ''"
        if n in K.SWITCHES:
            cond += f" AND {v} = 'true'"
        return f"CASE WHEN {cond} THEN '{n}=' || {v} END"

    def issue(n: str) -> str:
        v = f"p_{n}"
        sw = f" WHEN {v} NOT IN ('true', 'false') THEN '{K.R_BAD_BOOLEAN.format(name=n)}'" if n in K.SWITCHES else ""
        return (f"CASE WHEN {v} IS NULL THEN NULL WHEN regexp_matches({v}, '{ctrl}') "
                f"THEN '{K.R_UNSAFE_VALUE.format(name=n)}' WHEN {v} = '' THEN NULL{sw} END")

    base = f"WITH v_rules AS ({view_sql('v_rules')})\n"
    q: dict[str, str] = {}
    q["rule_active_fields"] = base + f"""
SELECT mailbox_id, rule_seq,
  array_to_string(list_filter([{', '.join(active(n) for n in props)}], lambda x: x IS NOT NULL), ', ') AS active,
  array_to_string(list_filter([{', '.join(issue(n) for n in props)}], lambda x: x IS NOT NULL), ' | ') AS field_issues
FROM v_rules"""

    def side(names: list[str], empty: str) -> str:
        items = ", ".join(f"CASE WHEN p_{n} IS NOT NULL THEN '{n}=' || p_{n} END" for n in names)
        return (f"coalesce(nullif(array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), ', '), ''), "
                f"'{empty}')")

    q["rule_description"] = base + f"""
SELECT mailbox_id, rule_seq,
  {side(K.CRITERIA, '(no conditions)')} || ' → ' || {side(K.ACTIONS, '(no actions)')} AS description
FROM v_rules"""
    return q


def input_queries() -> dict[str, str]:
    from .. import constants as K

    audit = f"""
v_archives AS ({view_sql('v_archives')}),
counts AS (SELECT batch_id, archive_id, count(*) AS entry_count FROM v_archives GROUP BY batch_id, archive_id),
e AS (
  SELECT a.*, NOT ends_with(entry_name, '/') AND (ends_with(lower(entry_name), '.xml')
         OR ends_with(lower(entry_name), '.mbox')) AND NOT starts_with(entry_name, '__MACOSX/') AS wanted
  FROM v_archives a),
e2 AS (
  SELECT *, sum(CASE WHEN wanted THEN uncompressed ELSE 0 END) OVER (
    PARTITION BY batch_id, archive_id ORDER BY entry_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
  FROM e),
e3 AS (
  SELECT *, CASE
    WHEN ends_with(entry_name, '/') AND uncompressed > 0 THEN 'directory_with_data'
    WHEN wanted AND uncompressed > {K.MAX_ENTRY} THEN 'entry_too_large'
    WHEN wanted AND running > {K.MAX_EXPANDED} THEN 'archive_too_large'
    WHEN wanted AND (flags % 2 = 1 OR method NOT IN (0, 8)) THEN 'unsupported_method'
    WHEN wanted AND method = 0 AND compressed <> uncompressed THEN 'stored_size_mismatch' END AS error
  FROM e2),
per AS (
  SELECT batch_id, archive_id,
    arg_min(error, entry_seq) FILTER (WHERE error IS NOT NULL) AS first_error,
    min(entry_seq) FILTER (WHERE error IS NOT NULL) AS error_entry,
    CAST(sum(CASE WHEN wanted THEN uncompressed ELSE 0 END) AS BIGINT) AS expanded,
    count(*) FILTER (WHERE wanted) AS accepted_count
  FROM e3 GROUP BY batch_id, archive_id),
audit AS (
  SELECT c.batch_id, c.archive_id, c.entry_count, coalesce(p.expanded, 0) AS expanded,
    coalesce(p.accepted_count, 0) AS accepted_count,
    CASE WHEN c.entry_count > {K.MAX_ENTRIES} THEN 'too_many_entries' ELSE p.first_error END AS error,
    CASE WHEN c.entry_count <= {K.MAX_ENTRIES} THEN p.error_entry END AS error_entry
  FROM counts c LEFT JOIN per p USING (batch_id, archive_id))"""
    q: dict[str, str] = {}
    q["archive_audit"] = "WITH " + audit + "\nSELECT *, error IS NULL AS ok FROM audit"
    q["archive_atomic"] = "WITH " + audit + """
SELECT batch_id, archive_id, entry_seq, entry_name, uncompressed FROM e
WHERE wanted AND (batch_id, archive_id) IN (SELECT batch_id, archive_id FROM audit WHERE error IS NULL)"""
    q["archive_batch_budget"] = "WITH RECURSIVE " + audit + f""",
ordered AS (
  SELECT batch_id, archive_id, expanded, error IS NULL AS ok,
         row_number() OVER (PARTITION BY batch_id ORDER BY archive_id) AS rn FROM audit),
rec AS (
  SELECT batch_id, rn, archive_id, ok AND expanded <= {K.MAX_BATCH_EXPANDED} AS taken,
         CASE WHEN ok AND expanded <= {K.MAX_BATCH_EXPANDED} THEN expanded ELSE 0 END AS total
  FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.batch_id, o.rn, o.archive_id, o.ok AND r.total + o.expanded <= {K.MAX_BATCH_EXPANDED},
         CASE WHEN o.ok AND r.total + o.expanded <= {K.MAX_BATCH_EXPANDED} THEN r.total + o.expanded ELSE r.total END
  FROM rec r JOIN ordered o ON o.batch_id = r.batch_id AND o.rn = r.rn + 1)
SELECT batch_id, archive_id, taken FROM rec"""
    files = f"WITH v_files AS ({view_sql('v_files')}),\n"
    adm = files + f"""adm AS (
  SELECT file_seq, path, size,
    CASE WHEN ends_with(lower(path), '.xml') THEN 'xml' WHEN ends_with(lower(path), '.mbox') THEN 'mbox'
         WHEN ends_with(lower(path), '.zip') THEN 'zip' ELSE 'other' END AS kind, mtime
  FROM v_files),
adm2 AS (
  SELECT *, CASE WHEN kind = 'xml' AND size > {K.MAX_XML} THEN 'xml_too_large'
    WHEN kind IN ('xml', 'mbox') THEN 'accepted'
    WHEN kind = 'zip' AND size > {K.MAX_ARCHIVE} THEN 'archive_too_large'
    WHEN kind = 'zip' THEN 'archive' ELSE 'unsupported' END AS verdict
  FROM adm)"""
    q["input_admission"] = adm + "\nSELECT file_seq, path, size, kind, verdict FROM adm2"
    q["expanded_inputs"] = q["archive_batch_budget"].replace("SELECT batch_id, archive_id, taken FROM rec", f"""
SELECT NULL::BIGINT AS archive_id, path AS name, size FROM ({q["input_admission"]}) WHERE verdict = 'accepted'
UNION ALL
SELECT e.archive_id, e.entry_name, e.uncompressed FROM e JOIN rec r ON r.batch_id = e.batch_id AND r.archive_id = e.archive_id WHERE e.wanted AND r.taken""")
    q["sent_hint"] = files.rstrip(",\n") + """
SELECT file_seq, path, regexp_matches(regexp_extract(lower(path), '([^/\\\\]*)$', 1),
  '(?i)^(sent|sent mail|已发送|已发送邮件|寄件備份|gesendet|envoyés)\\.mbox$') AS sent_hint FROM v_files"""
    q["import_dedup"] = adm + """,
sig AS (SELECT *, path || ':' || CAST(size AS VARCHAR) || ':' || CAST(mtime AS VARCHAR) AS signature FROM adm2)
SELECT file_seq, path, signature, verdict,
  verdict = 'accepted' AND file_seq > min(file_seq) OVER (PARTITION BY signature) AS duplicate
FROM sig"""
    return q


def folder_queries() -> dict[str, str]:
    from .. import constants as K

    system = ", ".join("'" + x.replace("'", "''") + "'" for x in K.SYSTEM)
    lists = " ".join(f"WHEN {k} THEN [" + ", ".join("'" + x.lower() + "'" for x in t["reserved"]) + "]" for k, t in enumerate(K.TARGETS))
    reserved = f"(CASE mailbox_id % {len(K.TARGETS)} {lists} END)"
    inv = "WITH RECURSIVE " + facts_cte() + """,
inv AS (SELECT DISTINCT mailbox_id, unnest(labels) AS label FROM efacts),
seg AS (
  SELECT mailbox_id, label, trim(nfc_normalize(label)) AS normalized FROM inv),
segs AS (
  SELECT *, list_transform(string_split(normalized, '/'), lambda p:
    CASE WHEN regexp_replace(regexp_replace(trim(p), '[\\x00-\\x1f\\x7f\\\\:*?"<>|]', '_', 'g'), '[ .]+$', '') IN ('', '.', '..')
         THEN '_' ELSE regexp_replace(regexp_replace(trim(p), '[\\x00-\\x1f\\x7f\\\\:*?"<>|]', '_', 'g'), '[ .]+$', '') END) AS parts
  FROM seg)"""
    q: dict[str, str] = {}
    q["folder_sanitize"] = inv + """
SELECT mailbox_id, label, array_to_string(list_transform(string_split(label, '/'), lambda p:
    CASE WHEN regexp_replace(regexp_replace(trim(p), '[\\x00-\\x1f\\x7f\\\\:*?"<>|]', '_', 'g'), '[ .]+$', '') IN ('', '.', '..')
         THEN '_' ELSE regexp_replace(regexp_replace(trim(p), '[\\x00-\\x1f\\x7f\\\\:*?"<>|]', '_', 'g'), '[ .]+$', '') END), '/') AS sanitized
FROM inv"""
    plan = inv + f""",
v_rules AS ({view_sql('v_rules')}),
v_overrides AS ({view_sql('v_overrides')}),
kept AS (
  SELECT *, array_to_string(parts, '/') AS base, {reserved} AS reserved, list_contains({reserved}, lower(normalized)) AS held FROM segs
  WHERE NOT (lower(normalized) IN ({system}) OR regexp_replace(lower(normalized), '^\\[gmail\\]/', '') IN ({system})
             OR regexp_matches(normalized, '(?i)^category:|^categories/|^\\\\(?:inbox|drafts?|junk|trash|flagged|all|important|seen)$'))),
ordered AS (SELECT *, row_number() OVER (PARTITION BY mailbox_id ORDER BY label) AS rn FROM kept WHERE NOT held),
-- Label after label, the first free name: as it is, then with (2), (3) and so on.
greedy AS (
  SELECT mailbox_id, 0::BIGINT AS rn, NULL::VARCHAR AS label, NULL::VARCHAR AS folder, 0::BIGINT AS n, []::VARCHAR[] AS used FROM ordered WHERE rn = 1
  UNION ALL
  SELECT mailbox_id, rn, label, CASE WHEN n = 1 THEN base ELSE base || ' (' || n || ')' END, n,
         list_append(used, lower(CASE WHEN n = 1 THEN base ELSE base || ' (' || n || ')' END))
  FROM (SELECT o.mailbox_id, o.rn, o.label, o.base, g.used,
               list_filter(range(1, len(g.used) + len(o.reserved) + 2), lambda k:
                 NOT list_contains(list_concat(g.used, o.reserved), lower(CASE WHEN k = 1 THEN o.base ELSE o.base || ' (' || k || ')' END)))[1] AS n
        FROM greedy g JOIN ordered o ON o.mailbox_id = g.mailbox_id AND o.rn = g.rn + 1)),
plan AS (
  SELECT k.mailbox_id, k.label, g.folder,
    array_to_string(list_filter([
      CASE WHEN base <> k.label THEN '{K.N_NORMALIZED}' END,
      CASE WHEN len(parts) > 1 THEN '{K.N_NESTED}' END,
      CASE WHEN length(base) > 255 THEN '{K.N_LONG}' END,
      CASE WHEN g.n > 1 THEN '{K.N_COLLISION}' END], lambda x: x IS NOT NULL), ' | ') AS notes
  FROM kept k JOIN greedy g ON g.mailbox_id = k.mailbox_id AND g.label = k.label
  UNION ALL
  SELECT mailbox_id, label, NULL, '{K.N_RESERVED}' FROM kept WHERE held),
rows AS (
  SELECT * FROM plan
  UNION ALL
  SELECT DISTINCT mailbox_id, p_label, '', '{K.N_RULE_MAPPING}' FROM v_rules r
  WHERE p_label <> '' AND NOT EXISTS (SELECT 1 FROM plan p WHERE p.mailbox_id = r.mailbox_id AND p.label = r.p_label)),
mapping AS (
  SELECT r.mailbox_id, r.label, coalesce(o.folder, r.folder, '') AS folder, notes
  FROM rows r LEFT JOIN (FROM v_overrides WHERE pick IN (3, 5, 7, 9, 11)) o ON o.mailbox_id = r.mailbox_id AND o.label = r.label)"""
    q["folder_plan"] = plan + "\nSELECT * FROM plan"
    note = "'[' || array_to_string(list_transform(list_filter(string_split(notes, ' | '), lambda x: x <> ''), lambda x: to_json(x)::VARCHAR), ',') || ']'"
    q["folder_manifest"] = plan + f"""
SELECT mailbox_id, label, CASE WHEN folder <> '' THEN 'folders' ELSE 'omitted' END AS part,
  '{{"gmailLabel":' || to_json(label)::VARCHAR || CASE WHEN folder <> '' THEN ',"targetFolder":' || to_json(folder)::VARCHAR || ',"create":true' ELSE '' END
  || ',"notes":' || {note} || '}}' AS entry
FROM mapping"""
    q["folder_mapping"] = plan + "\nSELECT * FROM mapping"
    q["all_labels"] = plan + """
SELECT mailbox_id, label FROM inv UNION SELECT mailbox_id, p_label FROM v_rules WHERE p_label <> ''"""
    q["mapping_errors"] = plan + f""",
keyed AS (SELECT *, lower(trim(nfc_normalize(folder))) AS key, {reserved} AS reserved,
                 count(*) OVER (PARTITION BY mailbox_id, lower(trim(nfc_normalize(folder)))) > 1 AS clash
          FROM mapping)
SELECT mailbox_id, label, folder, 'invalidFolder' AS error_key FROM keyed
  WHERE trim(folder) = '' OR regexp_matches(folder, '[\\x00-\\x1f\\x7f-\\x{{9f}}]')
UNION ALL SELECT mailbox_id, label, folder, 'reservedFolder' FROM keyed WHERE list_contains(reserved, key)
UNION ALL SELECT mailbox_id, label, folder, 'collision' FROM keyed WHERE clash"""
    specials = f"v_specials AS (SELECT * FROM ({view_sql('v_specials')}) WHERE pick = 0)"
    control = "[\\x00-\\x1f\\x7f-\\x{9f}]"
    q["special_errors"] = f"WITH {specials}\n" + "\nUNION ALL ".join(
        f"SELECT mailbox_id, '{n}' AS label, {n} AS folder, 'invalidFolder' AS error_key FROM v_specials WHERE trim({n}, ' ' || chr(9)) = '' OR regexp_matches({n}, '{control}')"
        for n in ("archiveFolder", "trashFolder"))
    heads = " UNION ALL ".join(
        f"SELECT {k} AS k, '{t['id']}' AS target, '{t['label']}' AS label, '{t['verifyStatus']}' AS status, '{t['archiveFolder']}' AS archive, '{t['trashFolder']}' AS trash, ["
        + ", ".join("'" + n.replace("'", "''") + "'" for n in t["notes"]) + "] AS notes" for k, t in enumerate(K.TARGETS))
    q["manifest_heads"] = f"""WITH {facts_cte()}, {specials}, heads AS ({heads})
SELECT b.mailbox_id, '' AS label, 'head' AS part, '{{"version":1,"target":' || to_json(h.target)::VARCHAR || ',"targetLabel":' || to_json(h.label)::VARCHAR || ',"targetVerifyStatus":' || to_json(status)::VARCHAR
  || ',"archiveFolder":' || to_json(coalesce(s.archiveFolder, archive))::VARCHAR || ',"trashFolder":' || to_json(coalesce(s.trashFolder, trash))::VARCHAR || ',"notes":' || to_json(notes)::VARCHAR || '}}' AS entry
FROM (SELECT DISTINCT mailbox_id FROM efacts) b JOIN heads h ON h.k = b.mailbox_id % {len(K.TARGETS)} LEFT JOIN v_specials s ON s.mailbox_id = b.mailbox_id"""
    # Destinations with the mapping: the folder of the label's row; archive and trash are the target's, as no label is called so.
    pick = lambda f: "CASE target " + " ".join(f"WHEN '{t['id']}' THEN '{t[f]}'" for t in K.TARGETS) + " END"
    key = lambda x: f"lower(trim(nfc_normalize({x})))"
    q["rule_destinations"] = plan + f""",
dest AS (
  SELECT mailbox_id, rule_seq, {pick('archiveFolder')} AS archive, {pick('trashFolder')} AS trash, p_label,
    CASE WHEN p_shouldTrash = 'true' THEN 'Trash' WHEN p_label <> '' THEN p_label WHEN p_shouldArchive = 'true' THEN 'Archive' END AS name, p_shouldTrash = 'true' AS trashes
  FROM v_rules),
placed AS (
  SELECT d.*, CASE WHEN name IS NULL THEN NULL WHEN trashes THEN trash WHEN p_label <> '' THEN m.folder ELSE archive END AS folder
  FROM dest d LEFT JOIN mapping m ON m.mailbox_id = d.mailbox_id AND m.label = d.p_label),
judged AS (
  SELECT *, trim(folder) = '' OR regexp_matches(folder, '{control}') AS bad,
    {key('folder')} = 'inbox' OR CASE WHEN p_label <> '' AND NOT coalesce(trashes, false) THEN {key('folder')} IN ({key('archive')}, {key('trash')}) ELSE {key('archive')} = {key('trash')} END
      OR EXISTS (SELECT 1 FROM mapping o WHERE o.mailbox_id = p.mailbox_id AND o.label <> p.name AND {key('o.folder')} = {key('p.folder')}) AS clash
  FROM placed p)
SELECT mailbox_id, rule_seq, CASE WHEN name IS NOT NULL AND NOT bad AND NOT clash THEN 'fileinto "' || replace(replace(folder, '\\', '\\\\'), '"', '\\"') || '";' ELSE '' END AS destination,
  CASE WHEN name IS NULL THEN '' WHEN bad THEN replace('{K.R_BAD_FOLDER}', '{{name}}', name) WHEN clash THEN replace('{K.R_COLLISION}', '{{name}}', name) ELSE '' END AS folder_issue
FROM judged"""
    q["folder_collisions"] = f"SELECT mailbox_id, rule_seq, folder_issue AS issue FROM ({q['rule_destinations']}) WHERE starts_with(folder_issue, '{K.R_COLLISION.split('{name}')[0]}')"
    q["migration_summary"] = f"""WITH r AS ({conversion_queries()['rule_status']}), m AS ({q['folder_mapping']}),
a AS (SELECT mailbox_id, count(*) FILTER (WHERE status = 'converted') AS active, count(*) FILTER (WHERE status = 'approximate') AS disabled FROM r GROUP BY ALL),
f AS (SELECT mailbox_id, count(*) AS folders FROM m WHERE folder <> '' GROUP BY ALL)
SELECT coalesce(a.mailbox_id, f.mailbox_id) AS mailbox_id, coalesce(active, 0) AS active, coalesce(disabled, 0) AS disabled, coalesce(folders, 0) AS folders
FROM a FULL JOIN f ON f.mailbox_id = a.mailbox_id"""
    return q


def matching_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    base = f"WITH v_msgs AS ({view_sql('v_msgs')})\n"
    q["source_summary"] = base + "SELECT mailbox_id, file_seq, count(*) AS records FROM v_msgs GROUP BY ALL"
    q["replacement_count"] = base + """
SELECT mailbox_id, file_seq, sum(length(v) - length(replace(v, chr(65533), '')))::BIGINT AS replacements
FROM (SELECT *, concat(from1, from2, label1, label2) AS v FROM v_msgs WHERE header_valid) GROUP BY ALL"""
    q["senders_csv"] = "WITH s AS (" + mailbox_queries()["sender_candidates"] + """)
SELECT mailbox_id, row_number() OVER (PARTITION BY mailbox_id ORDER BY messages DESC, email)::INT AS place,
       chr(13) || chr(10) || chr(34) || CASE WHEN regexp_matches(email, '^[=+@-]') THEN chr(39) ELSE '' END || email || chr(34) || ',' || messages || ',"",""' AS text FROM s
UNION ALL SELECT DISTINCT mailbox_id, 0, chr(65279) || '地址,邮件数量,置信度,来源' FROM s"""
    return q


def conversion_queries() -> dict[str, str]:
    """Rule conversion from the definitions: one row for each rule, every list in the order in which its parts are told."""
    from .. import constants as K

    rules = view_sql('v_rules')
    ctrl = "[\\x00-\\x1f\\x7f-\\x{9f}\\x{2028}\\x{2029}]"
    mailbox = ("(?i)[a-z0-9!#$%&''+/=?^_`~-]+(?:\\.[a-z0-9!#$%&''+/=?^_`~-]+)*@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\\.)+[a-z0-9](?:[a-z0-9-]*[a-z0-9])?")
    by_target = lambda f: "CASE target " + " ".join(f"WHEN '{t['id']}' THEN {f(t)}" for t in K.TARGETS) + " END"
    text = lambda x: "'" + x.replace("'", "''") + "'"
    strings = lambda x: "[" + ", ".join(map(text, x)) + "]::VARCHAR[]"
    quoted = lambda x: f"(chr(34) || replace(replace({x}, '\\', '\\\\'), chr(34), '\\' || chr(34)) || chr(34))"
    some = lambda *x: "list_filter([" + ", ".join(x) + "]::VARCHAR[], lambda v: v IS NOT NULL)"
    all_of = lambda x: f"(CASE WHEN len({x}) = 1 THEN {x}[1] ELSE 'allof (' || array_to_string({x}, ', ') || ')' END)"
    when = lambda c, x: f"CASE WHEN {c} THEN {x} END"

    def active(n: str) -> str:
        cond = f"NOT regexp_matches(p_{n}, '{ctrl}') AND p_{n} <> ''" + (f" AND p_{n} = 'true'" if n in K.SWITCHES else "")
        return f"CASE WHEN {cond} THEN p_{n} END AS {n.lower() if n not in ('from', 'to') else n + '_'}"

    def field_issue(n: str) -> str:
        bad = f" WHEN p_{n} NOT IN ('true', 'false', '') THEN {text(K.R_BAD_BOOLEAN.format(name=n))}" if n in K.SWITCHES else ""
        return f"CASE WHEN regexp_matches(p_{n}, '{ctrl}') THEN {text(K.R_UNSAFE_VALUE.format(name=n))}{bad} END"

    # Both searches of a rule are parsed as one table: even ids hold hasTheWord, odd ones doesNotHaveTheWord.
    source = f"""SELECT (mailbox_id * 64 + rule_seq) * 2 + side AS query_id, CASE side WHEN 0 THEN p_hasTheWord ELSE p_doesNotHaveTheWord END AS text
  FROM ({rules}) CROSS JOIN (SELECT unnest([0, 1]) AS side) WHERE CASE side WHEN 0 THEN p_hasTheWord ELSE p_doesNotHaveTheWord END <> ''"""

    def search(prefix: str, side: int, name: str) -> str:
        neg = "'not ' || " if name == "doesNotHaveTheWord" else ""
        return f"""{prefix} AS (
  SELECT s.query_id, CASE WHEN s.unsupported_text = '' AND len(c.parts) > 0 AND NOT list_contains(list_transform(c.parts, lambda x: x IS NULL), true)
           THEN {neg}{all_of('c.parts')} END AS test,
         list_concat(list_transform(CASE WHEN s.unsupported_text = '' THEN []::VARCHAR[] ELSE string_split(s.unsupported_text, ' | ') END, lambda x: '{name}: ' || x),
                     coalesce(c.issues, []::VARCHAR[])) AS issues, coalesce(c.warnings, []::VARCHAR[]) AS warnings
  FROM res s LEFT JOIN compiled c USING (query_id) WHERE s.query_id % 2 = {side})"""

    ext = by_target(lambda t: strings(t["extensions"] if t["kind"] == "sieve" else []))
    acts = by_target(lambda t: strings([] if t["kind"] != "sieve" else ["keep"] + (["fileinto"] if "fileinto" in t["extensions"] else [])
                                       + (["redirect"] if t["supportsRedirect"] else [])
                                       + (["addflag"] if "imap4flags" in t["extensions"] and t["supportsFlags"] else [])))
    act_bad = "CASE v " + " ".join(
        f"WHEN {text(a)} THEN {text(K.C_ACT_BAD.format(act=a, need=K.C_ACT_NEED.format(ext=K.ACTION_EXTENSIONS[a]) if a in K.ACTION_EXTENSIONS else ''))}"
        for a in ("addflag", "fileinto", "redirect", "keep")) + " END"
    key = lambda x: f"lower(trim(nfc_normalize({x})))"
    conv = search_cte(source) + f""",
pieces AS (
  SELECT query_id, neg, pos,
    CASE WHEN field IN ('from', 'to', 'cc') AND op = 'is' AND regexp_full_match(value, '{mailbox}') THEN 'address :is ' || {quoted('field')} || ' ' || {quoted('value')}
         WHEN field = 'size' THEN 'size :' || op || ' ' || num
         WHEN field = 'subject' AND op = 'contains' THEN 'header :contains "subject" ' || {quoted('value')} END AS expr,
    replace({text(K.R_QUERY_CONDITION)}, '{{raw}}', raw) AS issue, field = 'subject' AND op = 'contains' AS by_subject
  FROM tests),
compiled AS (
  SELECT query_id, list(CASE WHEN neg THEN 'not ' || expr ELSE expr END ORDER BY neg, pos) AS parts,
         coalesce(list(issue ORDER BY neg, pos) FILTER (WHERE expr IS NULL), []) AS issues,
         coalesce(list({text(K.R_QUERY_SUBJECT_WARN)} ORDER BY neg, pos) FILTER (WHERE by_subject), []) AS warnings
  FROM pieces GROUP BY query_id),
{search('hw', 0, 'hasTheWord')},
{search('dw', 1, 'doesNotHaveTheWord')},
v_rules AS ({rules}),
a AS (
  SELECT mailbox_id, rule_seq, rule_id, target, include_approximate, (mailbox_id * 64 + rule_seq) * 2 AS q,
         {', '.join(active(n) for n in K.CRITERIA + K.ACTIONS)},
         {some(*map(field_issue, K.CRITERIA + K.ACTIONS))} AS field_issues,
         {by_target(lambda t: text(t['archiveFolder']))} AS archive_folder, {by_target(lambda t: text(t['trashFolder']))} AS trash_folder,
         {by_target(lambda t: text(t['kind']))} AS kind, {ext} AS extensions, {acts} AS actions
  FROM v_rules),
b AS (
  SELECT a.*, hw.test AS hw_test, dw.test AS dw_test, hw.issues AS hw_issues, dw.issues AS dw_issues, hw.warnings AS hw_warnings, dw.warnings AS dw_warnings,
    regexp_full_match(from_, '{mailbox}') AS from_ok, regexp_full_match(to_, '{mailbox}') AS to_ok,
    regexp_full_match(subject, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}} .,_\'\'!?@&%-]*') AND NOT regexp_matches(subject, '\\b(?:OR|AND|NOT)\\b') AS subject_ok,
    CASE WHEN regexp_full_match(size, '\\d+') THEN TRY_CAST(size AS DECIMAL(38, 0)) END * CASE sizeunit WHEN 's_sb' THEN 1 WHEN 's_skb' THEN 1024 WHEN 's_smb' THEN 1048576 END AS amount,
    CASE sizeoperator WHEN 's_sl' THEN ':over' WHEN 's_ss' THEN ':under' END AS bound,
    CASE WHEN shouldtrash IS NOT NULL THEN 'Trash' WHEN label IS NOT NULL THEN label WHEN shouldarchive IS NOT NULL THEN 'Archive' END AS folder_name,
    CASE WHEN shouldtrash IS NOT NULL THEN trash_folder WHEN label IS NOT NULL THEN label WHEN shouldarchive IS NOT NULL THEN archive_folder END AS folder
  FROM a LEFT JOIN hw ON hw.query_id = a.q LEFT JOIN dw ON dw.query_id = a.q + 1),
c AS (
  SELECT *, amount IS NOT NULL AND amount <= {K.MAX_SIZE} AND bound IS NOT NULL AS size_ok,
    trim(folder) = '' OR regexp_matches(folder, '{ctrl}') AS folder_bad,
    {key('folder')} = 'inbox'
      OR CASE WHEN shouldtrash IS NULL AND label IS NOT NULL THEN {key('folder')} IN ({key('archive_folder')}, {key('trash_folder')})
              ELSE {key('archive_folder')} = {key('trash_folder')} END
      OR EXISTS (SELECT 1 FROM v_rules o WHERE o.mailbox_id = b.mailbox_id AND o.p_label <> '' AND o.p_label <> b.folder_name AND {key('o.p_label')} = {key('b.folder')}) AS collides
  FROM b),
d AS (
  SELECT *, {some(when('from_ok', "'address :is \"from\" ' || " + quoted('from_')), when('to_ok', "'address :is \"to\" ' || " + quoted('to_')),
                  when('subject_ok', "'header :contains \"subject\" ' || " + quoted('subject')), 'hw_test', 'dw_test',
                  when('size_ok', "'size ' || bound || ' ' || amount::BIGINT"))} AS tests,
    {some(when('shouldmarkasread IS NOT NULL', "'addflag \"\\\\Seen\";'"), when('shouldstar IS NOT NULL', "'addflag \"\\\\Flagged\";'"),
          when('folder_name IS NOT NULL AND NOT folder_bad AND NOT collides', "'fileinto ' || " + quoted('folder') + " || ';'"),
          when(f"regexp_full_match(forwardto, '{mailbox}')", "'redirect ' || " + quoted('forwardto') + " || ';'"),
          when('(label IS NOT NULL AND shouldarchive IS NULL AND shouldtrash IS NULL) OR (forwardto IS NOT NULL AND folder_name IS NULL)', "'keep;'"))} AS commands,
    {some(when('shouldmarkasread IS NOT NULL OR shouldstar IS NOT NULL', "'imap4flags'"), when('folder_name IS NOT NULL', "'fileinto'"))} AS needed,
    label IS NOT NULL OR shouldarchive IS NOT NULL OR shouldtrash IS NOT NULL OR forwardto IS NOT NULL AS delivery
  FROM c),
e AS (
  -- the verbs in the order in which they first come
  SELECT *, list_transform(commands, lambda v: replace(string_split(v, ' ')[1], ';', '')) AS verbs FROM d),
f AS (
  SELECT *, list_filter(list_transform(range(1, len(verbs) + 1), lambda k: CASE WHEN list_position(verbs, verbs[k]) = k THEN verbs[k] END), lambda v: v IS NOT NULL) AS used FROM e),
g1 AS (
  SELECT *, list_concat({some(when("kind = 'recipe'", text(K.R_RECIPE)), when(f"regexp_matches(rule_id, '{ctrl}')", text(K.R_UNSAFE_ID)))},
      field_issues, {some(*[when(f"{n.lower()} IS NOT NULL", text(K.R_NEVER.format(name=n))) for n in K.NEVER_CONVERTIBLE])},
      {some(when('from_ IS NOT NULL AND NOT from_ok', text(K.R_EXACT_ADDRESS.format(name='from'))), when('to_ IS NOT NULL AND NOT to_ok', text(K.R_EXACT_ADDRESS.format(name='to'))),
            when('subject IS NOT NULL AND NOT subject_ok', text(K.R_SUBJECT_SYNTAX)))},
      coalesce(hw_issues, []), coalesce(dw_issues, []),
      {some(when('size IS NOT NULL AND NOT size_ok', text(K.R_SIZE)), when('len(tests) = 0', text(K.R_NO_CONDITION)),
            when('shouldtrash IS NOT NULL AND (label IS NOT NULL OR shouldarchive IS NOT NULL)', text(K.R_AMBIGUOUS_TRASH)),
            when('folder_name IS NOT NULL AND folder_bad', f"replace({text(K.R_BAD_FOLDER)}, '{{name}}', folder_name)"),
            when('folder_name IS NOT NULL AND NOT folder_bad AND collides', f"replace({text(K.R_COLLISION)}, '{{name}}', folder_name)"),
            when(f"forwardto IS NOT NULL AND NOT regexp_full_match(forwardto, '{mailbox}')", text(K.R_FORWARD)), when('len(commands) = 0', text(K.R_NO_ACTION)))},
      list_transform(list_filter(needed, lambda v: NOT list_contains(extensions, v)), lambda v: replace({text(K.C_EXT_BAD)}, '{{ext}}', v)),
      list_transform(list_filter(used, lambda v: NOT list_contains(actions, v)), lambda v: {act_bad})) AS issues,
    list_concat({some(when("target = 'unknown'", text(K.R_UNKNOWN_TARGET)), when('subject_ok', text(K.R_SUBJECT_WARN)))}, coalesce(hw_warnings, []), coalesce(dw_warnings, []),
      {some(when('shouldmarkasread IS NOT NULL OR shouldstar IS NOT NULL', text(K.R_FLAGS_WARN)), when('shouldtrash IS NOT NULL', text(K.R_TRASH_WARN)),
            when('label IS NOT NULL AND shouldarchive IS NULL', text(K.R_LABEL_WARN)), when('shouldarchive IS NOT NULL', text(K.R_ARCHIVE_WARN)))}) AS warnings
  FROM f),
h AS (
  SELECT *, CASE WHEN len(issues) > 0 THEN 'skipped' WHEN len(warnings) > 0 THEN 'approximate' ELSE 'converted' END AS status1 FROM g1),
i AS (
  SELECT *, status1 <> 'skipped' AND count(*) FILTER (WHERE status1 <> 'skipped') OVER m > 1
            AND coalesce(bool_or(delivery) FILTER (WHERE status1 <> 'skipped') OVER m, false) AS several, count(*) OVER m AS n_rules
  FROM h WINDOW m AS (PARTITION BY mailbox_id)),
j AS (
  SELECT *, CASE WHEN several THEN 'approximate' ELSE status1 END AS status, (several OR status1 = 'approximate') AND NOT include_approximate AS disabled FROM i),
final AS (
  SELECT mailbox_id, rule_seq, rule_id, target, status, status <> 'skipped' AND NOT disabled AS enabled, needed, used, commands, n_rules, extensions, actions,
    list_concat(issues, warnings, {some(when('several', text(K.R_MULTIPLE)), when('disabled', text(K.R_DISABLED)))}) AS issues, list_sort(needed) AS required,
    CASE WHEN status = 'skipped' THEN '# Rule ' || rule_seq || ' skipped; see conversion report.'
      ELSE '# Rule ' || rule_seq
        || CASE WHEN status = 'approximate' THEN ' (approximate; ' || CASE WHEN disabled THEN 'DISABLED' ELSE 'explicitly enabled' END || '; review report)' ELSE '' END || chr(10)
        || CASE WHEN len(needed) > 0 THEN '# Needed at script top before enabling: require ['
             || array_to_string(list_transform(list_sort(needed), lambda v: chr(34) || v || chr(34)), ', ') || '];' || chr(10) ELSE '' END
        || CASE WHEN disabled THEN '# ' || replace(body, chr(10), chr(10) || '# ') ELSE body END END AS generated
  FROM (SELECT *, 'if ' || {all_of('tests')} || ' {{' || chr(10) || array_to_string(list_transform(commands, lambda v: '  ' || v), chr(10)) || chr(10) || '}}' AS body FROM j))"""
    q = {"rule_status": conv + """
SELECT mailbox_id, rule_seq, rule_id, target, status, enabled, array_to_string(issues, ' | ') AS issues, array_to_string(required, ',') AS required_extensions FROM final"""}
    q["rule_gaps"] = conv + """
SELECT mailbox_id, rule_seq, CAST(pos AS INTEGER) AS pos, rule_id || ': ' || issue AS gap
FROM (SELECT mailbox_id, rule_seq, rule_id, unnest(issues) AS issue, generate_subscripts(issues, 1) - 1 AS pos FROM final)"""
    q["status_summary"] = conv + """
SELECT mailbox_id, count(*) AS rules, count(*) FILTER (WHERE status = 'converted') AS converted, count(*) FILTER (WHERE status = 'approximate') AS approximate,
       count(*) FILTER (WHERE status = 'skipped') AS skipped FROM final GROUP BY mailbox_id"""
    q["required_extensions"] = conv + """
SELECT mailbox_id, string_agg(e, ',' ORDER BY e) AS required_extensions
FROM (SELECT DISTINCT mailbox_id, unnest(needed) AS e FROM final WHERE enabled) GROUP BY mailbox_id"""
    q["rule_script"] = conv + f"""
SELECT mailbox_id, rule_seq AS block, generated || CASE WHEN rule_seq = n_rules THEN chr(10) ELSE chr(10) || chr(10) END AS text FROM final
UNION ALL
SELECT mailbox_id, 0, {text(K.SCRIPT_HEADER.rstrip(chr(10)))} || chr(10) || coalesce('require [' || string_agg(chr(34) || e || chr(34), ', ' ORDER BY e) || '];' || chr(10) || chr(10), '')
FROM (SELECT DISTINCT m.mailbox_id, n.e FROM final m LEFT JOIN (SELECT DISTINCT mailbox_id, unnest(needed) AS e FROM final WHERE enabled) n USING (mailbox_id)) GROUP BY mailbox_id"""
    q["review_filter"] = conv + "\nSELECT mailbox_id, rule_seq, rule_id, status FROM final WHERE status = 'approximate'"
    q["gap_lines"] = f"""SELECT mailbox_id, row_number() OVER w::INT AS number, row_number() OVER w || '. ' || gap AS line FROM ({q['rule_gaps']})
WINDOW w AS (PARTITION BY mailbox_id ORDER BY rule_seq, pos)"""
    mask = "list_reduce(list_prepend(issue, regexp_extract_all(issue, '[^\\s<>\"''()]+@[^\\s<>\"''()]+')), lambda t, x: CASE WHEN contains(description, x) THEN t ELSE replace(t, x, '" + K.REDACTED + "') END)"
    described = rule_queries()["rule_description"]
    q["redact_issues"] = conv + f""",
told AS (SELECT f.mailbox_id, f.rule_seq, d.description, unnest(issues) AS issue, generate_subscripts(issues, 1) - 1 AS pos FROM final f JOIN ({described}) d USING (mailbox_id, rule_seq))
SELECT mailbox_id, rule_seq, pos::INT AS pos, {mask} AS issue FROM told"""
    steps = " || chr(10) || ".join(text(x) for x in K.RECIPE_STEPS)
    q["recipe_blocks"] = conv + f""",
told AS (
  SELECT f.mailbox_id, f.rule_seq, f.status, d.description, list_transform(issues, lambda issue: {mask}) AS issues,
    repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(description, '`+'), lambda r: length(r) + 1)), 3))) AS fence
  FROM final f JOIN ({described}) d USING (mailbox_id, rule_seq))
SELECT mailbox_id, rule_seq AS block, fence, chr(10) || {text(K.RECIPE_RULE)} || rule_seq || chr(10) || chr(10) || {text(K.RECIPE_ORIGINAL)} || chr(10) || fence || chr(10) || description || chr(10) || fence
  || chr(10) || chr(10) || {steps} || chr(10) || {text(K.RECIPE_STATUS)} || status || '。' || chr(10)
  || CASE WHEN len(issues) > 0 THEN array_to_string(list_transform(issues, lambda i: '- ' || i), chr(10)) ELSE {text(K.RECIPE_NO_ISSUE)} END || chr(10) || {text(K.RECIPE_LAST)} AS text
FROM told"""
    # Each rule against each message of its mailbox, test by test.
    reasons = "list_concat(field_issues, " + some(*[when(f"{n.lower()} IS NOT NULL", text(K.R_NEVER.format(name=n))) for n in K.NEVER_CONVERTIBLE if n in K.CRITERIA]) + ", " + some(
        when("from_ IS NOT NULL AND NOT from_ok", text(K.R_EXACT_ADDRESS.format(name="from"))), when("to_ IS NOT NULL AND NOT to_ok", text(K.R_EXACT_ADDRESS.format(name="to"))),
        when("subject IS NOT NULL AND NOT subject_ok", text(K.R_SUBJECT_SYNTAX))) + ", coalesce(hw_issues, []), coalesce(dw_issues, []), " + some(
        when("size IS NOT NULL AND NOT size_ok", text(K.R_SIZE)), when("len(tests) = 0", text(K.R_NO_CONDITION))) + ")"
    matches = conv + f""",
v_mail AS ({view_sql('v_mail')}),
mail AS (
  SELECT mailbox_id, msg_seq, size_bytes, lower(subject) AS subject, {d_sender('from1')} AS from_, list_filter([{d_sender('to1')}, {d_sender('to2')}], lambda x: x IS NOT NULL) AS to_, {d_sender('cc1')} AS cc
  FROM v_mail),
asked AS (SELECT mailbox_id, rule_seq, q, {reasons} AS reasons, from_, to_, subject, amount, bound FROM d),
held AS (
  SELECT k.query_id, m.mailbox_id, m.msg_seq,
    bool_and(coalesce(CASE k.field WHEN 'from' THEN m.from_ = lower(k.value) WHEN 'to' THEN list_contains(m.to_, lower(k.value)) WHEN 'cc' THEN m.cc = lower(k.value)
      WHEN 'size' THEN CASE k.op WHEN 'over' THEN m.size_bytes > k.num ELSE m.size_bytes < k.num END WHEN 'subject' THEN contains(m.subject, lower(k.value)) END, false) <> k.neg) AS all_hold
  FROM asked a JOIN tests k ON k.query_id IN (a.q, a.q + 1) JOIN mail m ON m.mailbox_id = a.mailbox_id
  WHERE len(a.reasons) = 0 GROUP BY ALL),
matches AS (
  SELECT a.mailbox_id, m.msg_seq, a.rule_seq
  FROM asked a JOIN mail m ON m.mailbox_id = a.mailbox_id
  LEFT JOIN held h ON h.query_id = a.q AND h.mailbox_id = m.mailbox_id AND h.msg_seq = m.msg_seq
  LEFT JOIN held n ON n.query_id = a.q + 1 AND n.mailbox_id = m.mailbox_id AND n.msg_seq = m.msg_seq
  WHERE len(a.reasons) = 0 AND coalesce(h.all_hold, true) AND NOT coalesce(n.all_hold, false)
    AND (a.from_ IS NULL OR coalesce(m.from_ = lower(a.from_), false)) AND (a.to_ IS NULL OR list_contains(m.to_, lower(a.to_)))
    AND (a.subject IS NULL OR coalesce(contains(m.subject, lower(a.subject)), false))
    AND (a.amount IS NULL OR CASE a.bound WHEN ':over' THEN m.size_bytes > a.amount ELSE m.size_bytes < a.amount END))"""
    q["rule_match"] = matches + "\nSELECT mailbox_id, msg_seq, rule_seq FROM matches"
    q["rule_hits"] = matches + """
SELECT a.mailbox_id, a.rule_seq, CASE WHEN len(reasons) > 0 THEN 'refused' WHEN count(x.msg_seq) > 0 THEN 'matched' ELSE 'unmatched' END AS verdict,
       count(x.msg_seq) AS hits, reasons[1] AS reason
FROM asked a LEFT JOIN matches x ON x.mailbox_id = a.mailbox_id AND x.rule_seq = a.rule_seq GROUP BY a.mailbox_id, a.rule_seq, reasons"""
    q["rule_overlap"] = matches + """
SELECT mailbox_id, count(*) AS matched, count(*) FILTER (WHERE n > 1) AS overlapping
FROM (SELECT mailbox_id, msg_seq, count(*) AS n FROM matches GROUP BY ALL) GROUP BY mailbox_id"""
    ok = "CASE v " + " ".join(f"WHEN {text(a)} THEN {text(K.C_ACT_OK.format(act=a))}" for a in ("addflag", "fileinto", "redirect", "keep")) + " END"
    q["capability_check"] = conv + f""",
told AS (
  SELECT mailbox_id, rule_seq, target, list_concat(
    list_transform(needed, lambda v: {{'supported': list_contains(extensions, v), 'message': CASE WHEN list_contains(extensions, v) THEN replace({text(K.C_EXT_OK)}, '{{ext}}', v)
      ELSE replace({text(K.C_EXT_BAD)}, '{{ext}}', v) END}}),
    list_transform(used, lambda v: {{'supported': list_contains(actions, v), 'message': CASE WHEN list_contains(actions, v) THEN {ok} ELSE {act_bad} END}})) AS m FROM final)
SELECT mailbox_id, rule_seq, target, CAST(pos AS INTEGER) AS pos, x.supported AS supported, x.message AS message
FROM (SELECT mailbox_id, rule_seq, target, unnest(m) AS x, generate_subscripts(m, 1) - 1 AS pos FROM told)"""
    q["capability_matrix"] = f"SELECT target, message, bool_or(supported) AS supported, count(*) AS rules FROM ({q['capability_check']}) GROUP BY target, message"
    return q


def mbox_queries() -> dict[str, str]:
    """A line after the other over whole files, with no blocks."""
    from .. import constants as K

    lines = f"""WITH v_mbox_lines AS ({view_sql('v_mbox_lines')}),
l1 AS (SELECT mailbox_id, file_id, row_number() OVER (PARTITION BY mailbox_id, file_id ORDER BY pos) AS i, regexp_replace(line, '\\r$', '') AS t FROM v_mbox_lines),
l2 AS (
  SELECT *, CASE WHEN length(t) > {K.MAX_LINE} THEN 'long' WHEN t = '' THEN 'blank'
    WHEN regexp_full_match(t, 'From \\S+ (Mon|Tue|Wed|Thu|Fri|Sat|Sun)\\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\\s+\\d{{1,2}}\\s+\\d{{2}}:\\d{{2}}(:\\d{{2}})?\\s+(\\S+\\s+)?\\d{{4}}(\\s.*)?') THEN 'envelope'
    WHEN t[1] IN (' ', chr(9)) THEN 'continuation' WHEN regexp_full_match(t, '[!-9;-~]+:.*') THEN 'header' ELSE 'other' END AS kind
  FROM l1),
l3 AS (
  SELECT *, min(CASE WHEN kind <> 'blank' THEN i END) OVER f AS first_text,
         kind IN ('blank', 'other', 'long') OR (kind = 'continuation' AND lag(kind) OVER (PARTITION BY mailbox_id, file_id ORDER BY i) = 'envelope') AS closes
  FROM l2 WINDOW f AS (PARTITION BY mailbox_id, file_id)),
l4 AS (SELECT *, kind = 'envelope' OR (kind = 'header' AND i = first_text) AS starts FROM l3),
l5 AS (
  SELECT *, count(*) FILTER (starts) OVER w AS msg_seq, max(i) FILTER (starts) OVER w AS opened,
         coalesce(max(i) FILTER (closes) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed
  FROM l4 WINDOW w AS (PARTITION BY mailbox_id, file_id ORDER BY i)),
rows_of AS MATERIALIZED (SELECT *, kind <> 'envelope' AND opened > closed AS inside FROM l5 WHERE msg_seq > 0),
bounds AS (
  SELECT mailbox_id, file_id, msg_seq, count(*) FILTER (inside AND kind = 'header') AS header_count,
         coalesce(sum(length(t) + 2) FILTER (inside), 0)::BIGINT AS header_chars,
         coalesce(bool_or(inside AND closes AND kind <> 'blank'), false) AS broken, coalesce(bool_or(inside AND kind = 'long'), false) AS long_line
  FROM rows_of GROUP BY ALL),
parts AS (
  SELECT *, count(*) FILTER (kind = 'header') OVER (PARTITION BY mailbox_id, file_id, msg_seq ORDER BY i) AS field_seq FROM rows_of WHERE inside AND NOT closes),
fields AS (
  SELECT mailbox_id, file_id, msg_seq, field_seq, lower(string_agg(regexp_extract(t, '^([!-9;-~]+):', 1), '') FILTER (kind = 'header')) AS name,
         string_agg(CASE WHEN kind = 'header' THEN regexp_extract(t, '^[!-9;-~]+:[ \\t]*(.*)$', 1) ELSE trim(t, chr(9) || ' ') END, ' ' ORDER BY i) AS value
  FROM parts GROUP BY ALL),
messages AS (
  SELECT b.*, long_line OR header_chars > {K.MAX_HEADERS} AS over_bounds,
         NOT (long_line OR header_chars > {K.MAX_HEADERS}) AND NOT broken AND header_count > 0 AS header_valid
  FROM bounds b)"""

    def values(name: str) -> str:
        return (f"coalesce((SELECT string_agg(value, ' | ' ORDER BY field_seq) FROM fields f WHERE f.mailbox_id = m.mailbox_id AND f.file_id = m.file_id "
                f"AND f.msg_seq = m.msg_seq AND f.name = '{name}'), '')")

    q: dict[str, str] = {}
    q["mbox_messages"] = lines + f"""
SELECT mailbox_id, file_id, msg_seq, header_count, header_valid, {values('from')} AS from_values, {values('message-id')} AS id_values,
       {values('x-gmail-labels')} AS label_values FROM messages m"""
    q["header_bounds"] = lines + "\nSELECT mailbox_id, file_id, msg_seq, header_chars, over_bounds FROM messages"
    q["header_fields"] = lines + "\nSELECT mailbox_id, file_id, msg_seq, field_seq, name, value FROM fields"
    q["header_decode"] = lines + f"\nSELECT mailbox_id, file_id, msg_seq, field_seq, name, CASE WHEN starts_with(value, '=?utf-8?B?') THEN decode(from_base64(regexp_extract(value, '{B_WORD}', 1))) || regexp_replace(value, '{B_WORD}', '') ELSE value END AS decoded FROM fields"
    q["mbox_senders"] = lines + f""",
one AS (
  SELECT m.mailbox_id, m.file_id, m.msg_seq, list(value) FILTER (name = 'from') AS froms, list(value) FILTER (name = 'message-id') AS ids,
         list(value) FILTER (name = 'x-gmail-labels') AS labels
  FROM messages m JOIN fields f USING (mailbox_id, file_id, msg_seq) WHERE header_valid GROUP BY ALL),
facts AS (
  SELECT mailbox_id, file_id, msg_seq, {d_sender('froms[1]')} AS email,
         CASE WHEN len(ids) = 1 AND regexp_full_match(trim(ids[1]), '<[^<>\\s]+@[^<>\\s]+>') THEN trim(ids[1]) END AS id
  FROM one
  WHERE len(froms) = 1 AND len(list_filter(flatten(list_transform(labels, lambda v: {d_labels('v')})), lambda x: lower(x) IN ('sent', '已发送'))) > 0),
firsts AS (SELECT *, row_number() OVER (PARTITION BY mailbox_id, id ORDER BY file_id, msg_seq) AS rn FROM facts WHERE email IS NOT NULL)
SELECT mailbox_id, email, count(*) AS messages FROM firsts WHERE rn = 1 OR id IS NULL GROUP BY mailbox_id, email"""
    return q


def feed_queries() -> dict[str, str]:
    """The entries property by property, by patterns over their text."""
    from .. import constants as K

    base = f"""WITH v_feed_entries AS ({view_sql('v_feed_entries')}),
verdicts AS (
  SELECT mailbox_id, CASE WHEN any_value(head) LIKE '<!DOCTYPE%' THEN 'doctype' WHEN any_value(head) NOT LIKE '%xmlns="{K.ATOM_NAMESPACE}"%' THEN 'not_a_feed' ELSE 'accepted' END AS verdict
  FROM v_feed_entries GROUP BY mailbox_id),
e AS (
  SELECT mailbox_id, row_number() OVER (PARTITION BY mailbox_id ORDER BY place)::INT AS rule_seq, head, regexp_replace(entry, '<!--.*?-->', '', 'g') AS entry
  FROM v_feed_entries JOIN verdicts USING (mailbox_id) WHERE verdict = 'accepted'),
p AS (
  SELECT mailbox_id, rule_seq, generate_subscripts(tags, 1) AS pos, unnest(tags) AS tag, head || entry AS scope
  FROM (SELECT *, regexp_extract_all(entry, '<(?:[a-z]+:)?property[^>]*/>') AS tags FROM e)),
q AS (
  SELECT mailbox_id, rule_seq, pos, nullif(regexp_extract(tag, ' name="([^"]*)"', 1), '') AS name,
         CASE WHEN contains(tag, ' value="') THEN replace(replace(replace(replace(regexp_extract(tag, ' value="([^"]*)"', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') END AS value,
         contains(scope, 'xmlns:' || nullif(regexp_extract(tag, '^<([a-z]+):', 1), '') || '="{K.APPS_NAMESPACE}"') AS apps
  FROM p),
r AS (SELECT *, coalesce(apps, false) AND name IS NOT NULL AND value IS NOT NULL AS sound FROM q),
t AS (SELECT *, sound AND row_number() OVER (PARTITION BY mailbox_id, rule_seq, name, sound ORDER BY pos) = 1 AS own FROM r)"""
    names = ("from", "to", "subject", "hasTheWord", "size", "label", "shouldStar")
    known = ", ".join(f"'{n}'" for n in K.CRITERIA + K.ACTIONS)
    return {"filter_feed": base + "\nSELECT mailbox_id, verdict FROM verdicts",
            "redact_unknown": base + f"""
SELECT mailbox_id, rule_seq, (row_number() OVER (PARTITION BY mailbox_id, rule_seq ORDER BY pos) - 1)::INT AS pos,
  CASE WHEN own THEN 'Unsupported XML property: ' || regexp_replace(name, '^.*@.*$', '{K.REDACTED}') ELSE 'Invalid or duplicate property: ' || coalesce(name, '(unnamed)') END AS issue
FROM t WHERE NOT own OR name NOT IN ({known})""",
            "filter_rules": base + f"""
SELECT e.mailbox_id, e.rule_seq, coalesce(nullif(regexp_extract(any_value(e.entry), '<id>([^<]*)</id>', 1), ''), 'rule-' || e.rule_seq) AS rule_id,
       {', '.join(f"any_value(value) FILTER (own AND name = '{n}') AS p_{n}" for n in names)},
       coalesce(string_agg(CASE WHEN own THEN 'Unsupported XML property: ' || name ELSE 'Invalid or duplicate property: ' || coalesce(name, '(unnamed)') END, ' | ' ORDER BY pos)
         FILTER (NOT own OR name NOT IN ({known})), '') AS unknown
FROM e LEFT JOIN t ON t.mailbox_id = e.mailbox_id AND t.rule_seq = e.rule_seq GROUP BY e.mailbox_id, e.rule_seq"""}
