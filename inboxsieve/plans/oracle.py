"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark code from the same fixed values (RE2
spelling of the patterns, DuckDB JSON functions, a recursive CTE for the
claim fold).  The tables ``documents labels conversations events part`` are
views in the oracle's connection.
"""

from __future__ import annotations

from ..functions.jsre import JS_WS_CHARS, WS_RE2
from ..functions.service_types import SERVICE_IDS, SERVICE_TYPES, lookup_entries
from ..operators.contract import SAFE_ALERT_REASON
from ..operators.sanitize import EVAL_REJECT_REASON, INBOUND_REJECT_REASON
from ..sources import driver_tables as dt

ORACLE: dict[str, str] = {}


def lit(s: str) -> str:
    """A DuckDB string expression for ``s`` (control and non-ASCII chars via chr())."""
    parts: list[str] = []
    buf = ""
    for ch in s:
        if 32 <= ord(ch) < 127:
            buf += "''" if ch == "'" else ch
        else:
            if buf:
                parts.append(f"'{buf}'")
                buf = ""
            parts.append(f"chr({ord(ch)})")
    if buf or not parts:
        parts.append(f"'{buf}'")
    return "(" + " || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def q(s: str) -> str:
    """A plain single-quoted literal (for regex patterns, kept verbatim)."""
    return "'" + s.replace("'", "''") + "'"


WSSET = lit(JS_WS_CHARS)
NL = "chr(10)"


def trim_js(x: str) -> str:
    return f"trim({x}, {WSSET})"


def rtrim_js(x: str) -> str:
    return f"rtrim({x}, {WSSET})"


# Fixed values, here to the separators and sign-offs below: RE2 spellings of
# the PII patterns (``\b`` is ASCII in RE2, as in JS).
RE2_PII = [
    (r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", "[EMAIL]"),
    (rf"(?:\+?1[-.{WS_RE2}]?)?(?:\(?\d{{3}}\)?[-.{WS_RE2}]?)\d{{3}}[-.{WS_RE2}]?\d{{4}}", "[PHONE]"),
    (rf"(?i)\bhttps?://[^{WS_RE2}]+", "[URL]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
    (r"\b(?:\d[ -]*?){13,16}\b", "[CARD_NUMBER]"),
]
RE2_SEP = rf"\n--[{WS_RE2}]*\n"
RE2_SIGNOFF = (r"(?i)^(thanks|thank you|best|best regards|regards|kind regards|sincerely|"
               rf"cheers|warmly|respectfully)[,!.{WS_RE2}]*$")
RE2_SENT = r"(?i)^sent from my "


def redact(x: str) -> str:
    for pattern, token in RE2_PII:
        x = f"regexp_replace({x}, {q(pattern)}, {q(token)}, 'g')"
    return x


def case_list(index: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values))
    return f"CASE {index} {whens} END"


EMAILS_CTE = f"""emails AS (
  SELECT doc_id AS email_id,
         'customer' || CAST(doc_id AS VARCHAR) || '@example.com' AS "from",
         CASE doc_id % 13 WHEN 0 THEN '' WHEN 1 THEN '   ' ELSE split_part(text, {NL}, 1) END AS subject,
         text || {case_list('doc_id % 8', dt.BODY_SUFFIXES)} AS text,
         lang
  FROM documents)"""


def strip_ctes(src: str, col: str) -> str:
    """CTEs ``sig_a``/``sig_b`` computing the stripped ``{col}`` of ``src``
    (which has email_id and col); final expression is :data:`STRIPPED`."""
    return f"""sig_a AS (
  SELECT email_id, n,
         regexp_matches(n, {q(RE2_SEP)}) AS has_sep,
         regexp_extract(n, {q('^(?s:(.*?))' + RE2_SEP)}, 1) AS before_sep,
         string_split(n, {NL}) AS lines
  FROM (SELECT email_id, replace({col}, chr(13) || chr(10), {NL}) AS n FROM {src})),
sig_b AS (
  SELECT *, greatest(len(lines) - 10, 0) AS first0,
         list_max(list_transform(lines[greatest(len(lines) - 10, 0) + 1:],
           lambda l, i: CASE WHEN regexp_matches({trim_js('l')}, {q(RE2_SIGNOFF)})
                               OR regexp_matches({trim_js('l')}, {q(RE2_SENT)}) THEN i END)) AS hit1
  FROM sig_a)"""


STRIPPED = f"""CASE WHEN has_sep THEN {rtrim_js('before_sep')} || {NL} || '[SIGNATURE_REMOVED]'
     WHEN hit1 IS NOT NULL THEN {rtrim_js(f"array_to_string(lines[1:first0 + hit1 - 1], {NL})")} || {NL} || '[SIGNATURE_REMOVED]'
     ELSE n END"""

SANITIZED_CTES = f"""{EMAILS_CTE},
{strip_ctes('emails', 'coalesce(text, \'\')')},
sanitized AS (
  SELECT e.email_id, {redact('e.subject')} AS subject, {redact('s.body0')} AS body
  FROM emails e JOIN (SELECT email_id, {STRIPPED} AS body0 FROM sig_b) s USING (email_id))"""

ORACLE["redact_pii"] = f"""WITH {EMAILS_CTE}
SELECT email_id, {redact('subject')} AS subject, {redact('text')} AS body FROM emails"""

ORACLE["strip_signatures"] = f"""WITH {EMAILS_CTE},
{strip_ctes('emails', 'text')}
SELECT email_id, {STRIPPED} AS body FROM sig_b"""

ORACLE["sanitize_emails"] = f"""WITH {SANITIZED_CTES}
SELECT email_id, subject, body FROM sanitized"""

ORACLE["screen_inputs"] = f"""WITH {SANITIZED_CTES}
SELECT s.email_id,
  CASE WHEN e.subject IS NULL OR e.text IS NULL OR {trim_js('e.subject')} = '' OR {trim_js('e.text')} = ''
       THEN {q(EVAL_REJECT_REASON)} END AS eval_reject_reason,
  CASE WHEN s.subject IS NULL OR s.body IS NULL OR s.subject = '' OR s.body = ''
       THEN {q(INBOUND_REJECT_REASON)} END AS inbound_reject_reason
FROM sanitized s JOIN emails e USING (email_id)"""

ORACLE["prescreen"] = f"""WITH {EMAILS_CTE}
SELECT email_id,
  CASE WHEN regexp_matches(coalesce(text, ''), {q('^[' + WS_RE2 + ']*$')}) THEN 'empty_body'
       WHEN regexp_matches(coalesce(subject, '') || {NL} || coalesce(text, ''), '(?i)\\bunsubscribe\\b')
       THEN 'unsubscribe_footer' END AS prescreen_rule
FROM emails"""


# ------------------------------------------------------------------ blocks
def obj_sql(sid: str, score: str, alert: str | None, reason: str, extra: str = "") -> str:
    s = (f"""'{{"explanation": "' || expl || '", "serviceTypeId": "' || {sid} || '", "confidenceScore": ' || {score}""")
    if alert is not None:
        s += f""" || ', "shouldAlertAdmin": ' || {alert}"""
    s += f""" || ', "alertReason": "' || {reason} || '"'"""
    if extra:
        s += f" || {q(extra)}"
    return s + " || '}'"


PLAIN = obj_sql("sid", "score", "alert", "reason")
ANSWER_CASE = f"""CASE shape
  WHEN 0 THEN {PLAIN}
  WHEN 1 THEN '```json' || {NL} || {PLAIN} || {NL} || '```'
  WHEN 2 THEN 'Here is the result: ' || {PLAIN} || ' Hope it helps.'
  WHEN 3 THEN '{{not valid json ' || CAST(seed AS VARCHAR)
  WHEN 4 THEN substring({PLAIN}, 1, length({PLAIN}) - 12)
  WHEN 5 THEN {obj_sql("'unknown'", "'0.95'", "'true'", "reason")}
  WHEN 6 THEN {obj_sql("sid", "score", None, "reason")}
  WHEN 7 THEN {obj_sql("sid", "score", "alert", "reason", ', "extra": 1')}
  WHEN 8 THEN {obj_sql("sid", "'\"' || score || '\"'", "alert", "reason")}
  WHEN 9 THEN '[' || {PLAIN} || ']'
  WHEN 10 THEN {PLAIN} || ' ' || {PLAIN}
  ELSE {obj_sql("sid", "score", "alert", "'   '")} END"""


def answers_cte(name: str, src: str, seed: str, hint: str, keep: str) -> str:
    """A CTE ``name`` with ``keep`` columns of ``src`` plus ``text`` = the
    synthetic answer for (seed, hint)."""
    ids = "[" + ", ".join(q(x) for x in dt.ANSWER_IDS) + "]"
    return f"""{name}_f AS (
  SELECT {keep}, {seed} AS seed, ({seed}) % 12 AS shape,
         {ids}[CAST(floor(({seed}) / 12) AS BIGINT) % 6 + 1] AS sid,
         (({seed}) * 37) % 101 AS score_int,
         replace(replace(replace(replace(replace({hint}, '\\', '\\\\'), '"', '\\"'), {NL}, '\\n'), chr(13), '\\r'), chr(9), '\\t') AS words
  FROM {src}),
{name}_g AS (
  SELECT *, CAST(score_int AS VARCHAR) || 'e-2' AS score,
         CASE WHEN score_int > 70 AND sid <> 'unknown' THEN 'true' ELSE 'false' END AS alert,
         'Mail ' || CAST(seed AS VARCHAR) || ': ' || words AS expl,
         'Reason for ' || CAST(seed AS VARCHAR) AS reason
  FROM {name}_f),
{name} AS (SELECT {keep}, {ANSWER_CASE} AS text FROM {name}_g)"""


BLOCKS_CTE = answers_cte(
    "blocks_t",
    "(SELECT conv_id AS run_id, turn AS pos, CASE WHEN role = 'system' THEN 'thinking' ELSE 'text' END AS type, "
    "text AS src_text FROM conversations)",
    "run_id * 7 + pos", "src_text", "run_id, pos, type")

NUMBER_TYPES = "('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT')"
KEYS = "['explanation', 'serviceTypeId', 'confidenceScore', 'shouldAlertAdmin', 'alertReason']"
ENUM = "(" + ", ".join(q(x) for x in SERVICE_IDS) + ")"


def validate_ctes(src: str, keep: str, text: str = "text", name: str = "checked") -> str:
    """CTEs ending in ``name`` with ``keep``, json_text, valid, issues and the
    trimmed result fields (NULL when invalid)."""
    return f"""{name}_n AS (
  SELECT {keep}, w AS w0,
         CASE WHEN starts_with(w, '{{') AND ends_with(w, '}}') THEN w
              WHEN strpos(w, '{{') > 0 AND (CASE WHEN strpos(reverse(w), '}}') > 0 THEN length(w) - strpos(reverse(w), '}}') + 1 ELSE 0 END) > strpos(w, '{{')
              THEN substring(w, strpos(w, '{{'), length(w) - strpos(reverse(w), '}}') + 1 - strpos(w, '{{') + 1)
              ELSE w END AS json_text
  FROM (SELECT {keep}, {trim_js(f"regexp_replace(regexp_replace({trim_js(text)}, {q('(?i)^```(?:json)?[' + WS_RE2 + ']*')}, ''), {q('(?i)[' + WS_RE2 + ']*```$')}, '')")} AS w
        FROM {src})),
{name}_j AS (
  SELECT *, CASE WHEN json_valid(json_text) THEN CAST(json_text AS JSON) END AS j FROM {name}_n),
{name}_t AS (
  SELECT *, json_type(j) AS root,
         json_type(j, '$.explanation') AS t_expl, {trim_js("json_extract_string(j, '$.explanation')")} AS expl,
         json_type(j, '$.serviceTypeId') AS t_sid, json_extract_string(j, '$.serviceTypeId') AS sid,
         json_type(j, '$.confidenceScore') AS t_score,
         CASE WHEN json_type(j, '$.confidenceScore') IN {NUMBER_TYPES}
              THEN CAST(json_extract(j, '$.confidenceScore') AS DOUBLE) END AS score,
         json_type(j, '$.shouldAlertAdmin') AS t_alert,
         CASE WHEN json_type(j, '$.shouldAlertAdmin') = 'BOOLEAN'
              THEN CAST(json_extract(j, '$.shouldAlertAdmin') AS BOOLEAN) END AS alert,
         json_type(j, '$.alertReason') AS t_reason, {trim_js("json_extract_string(j, '$.alertReason')")} AS reason,
         len(list_filter(json_keys(j), lambda k: NOT list_contains({KEYS}, k))) > 0 AS extra
  FROM {name}_j),
{name}_i AS (
  SELECT *, list_filter([
      CASE WHEN t_expl IS NULL THEN 'explanation:missing' WHEN t_expl <> 'VARCHAR' THEN 'explanation:invalid_type'
           WHEN expl = '' THEN 'explanation:too_small' END,
      CASE WHEN t_sid IS NULL THEN 'serviceTypeId:missing'
           WHEN t_sid <> 'VARCHAR' OR sid NOT IN {ENUM} THEN 'serviceTypeId:invalid_enum' END,
      CASE WHEN t_score IS NULL THEN 'confidenceScore:missing'
           WHEN t_score NOT IN {NUMBER_TYPES} THEN 'confidenceScore:invalid_type'
           WHEN score < 0 OR score > 1 OR isnan(score) THEN 'confidenceScore:out_of_range' END,
      CASE WHEN t_alert IS NULL THEN 'shouldAlertAdmin:missing'
           WHEN t_alert <> 'BOOLEAN' THEN 'shouldAlertAdmin:invalid_type' END,
      CASE WHEN t_reason IS NULL THEN 'alertReason:missing' WHEN t_reason <> 'VARCHAR' THEN 'alertReason:invalid_type'
           WHEN reason = '' THEN 'alertReason:too_small' END,
      CASE WHEN extra THEN 'unrecognized_keys' END], lambda x: x IS NOT NULL) AS base
  FROM {name}_t),
{name} AS (
  SELECT *,
    CASE WHEN j IS NULL THEN ['invalid_json'] WHEN root <> 'OBJECT' THEN ['not_object']
         WHEN len(base) > 0 THEN base
         ELSE list_filter([CASE WHEN alert AND sid = 'unknown' THEN 'shouldAlertAdmin:unknown_service' END,
                           CASE WHEN alert AND score <= 0.7 THEN 'shouldAlertAdmin:confidence_not_above_0.7' END],
                          lambda x: x IS NOT NULL) END AS issues
  FROM {name}_i)"""


RESULT_COLS = """CASE WHEN valid THEN expl END AS explanation, CASE WHEN valid THEN sid END AS service_type_id,
  CASE WHEN valid THEN score END AS confidence_score, CASE WHEN valid THEN alert END AS should_alert_admin,
  CASE WHEN valid THEN reason END AS alert_reason"""

CHECKED_CTES = f"""{BLOCKS_CTE},
{validate_ctes("(SELECT * FROM blocks_t WHERE type = 'text')", "run_id, pos, type")},
checked_v AS (SELECT *, len(issues) = 0 AS valid FROM checked)"""

ORACLE["extract_json"] = f"""WITH {CHECKED_CTES}
SELECT run_id, pos, json_text FROM checked_v"""

ORACLE["validate_output"] = f"""WITH {CHECKED_CTES}
SELECT run_id, pos, valid, array_to_string(issues, '|') AS issues, {RESULT_COLS} FROM checked_v"""

WINNERS_CTES = f"""{CHECKED_CTES},
per_run AS (
  SELECT b.run_id, min(b.pos) FILTER (WHERE c.valid) AS winner_pos, count(*) AS n_blocks
  FROM blocks_t b LEFT JOIN checked_v c ON c.run_id = b.run_id AND c.pos = b.pos GROUP BY b.run_id),
errs AS (
  SELECT c.run_id, count(*) AS n FROM checked_v c JOIN per_run p USING (run_id)
  WHERE NOT c.valid AND (p.winner_pos IS NULL OR c.pos < p.winner_pos) GROUP BY c.run_id),
winners AS (
  SELECT p.run_id, p.winner_pos, p.n_blocks, coalesce(e.n, 0) AS n_parse_errors,
         w.expl AS explanation, w.sid AS service_type_id, w.score AS confidence_score,
         w.alert AS should_alert_admin, w.reason AS alert_reason
  FROM per_run p LEFT JOIN errs e USING (run_id)
  LEFT JOIN checked_v w ON w.run_id = p.run_id AND w.pos = p.winner_pos)"""

ORACLE["first_valid_block"] = f"""WITH {WINNERS_CTES}
SELECT * FROM winners"""

SAFE_REASON_SQL = (f"CASE WHEN run_id % 9 = 0 THEN {q(SAFE_ALERT_REASON + ' Model error: upstream timeout')} "
                   f"ELSE {q(SAFE_ALERT_REASON)} END")

FALLBACK_CTES = f"""{WINNERS_CTES},
final AS (
  SELECT run_id, winner_pos IS NULL AS fallback,
    coalesce(explanation, {SAFE_REASON_SQL}) AS explanation,
    coalesce(service_type_id, 'unknown') AS service_type_id,
    coalesce(confidence_score, 0.0) AS confidence_score,
    coalesce(should_alert_admin, false) AS should_alert_admin,
    coalesce(alert_reason, {SAFE_REASON_SQL}) AS alert_reason
  FROM winners)"""

ORACLE["safe_fallback"] = f"""WITH {FALLBACK_CTES}
SELECT * FROM final"""


def resolve_sql(x: str) -> tuple[str, str]:
    norm = f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"
    entries = lookup_entries()
    ids = " ".join(f"WHEN {q(k)} THEN {q(SERVICE_TYPES[o]['id'])}" for k, o in entries)
    labels = " ".join(f"WHEN {q(k)} THEN {q(SERVICE_TYPES[o]['label'])}" for k, o in entries)
    return f"CASE {norm} {ids} END", f"CASE {norm} {labels} END"


_SID, _SLABEL = resolve_sql("value")
ORACLE["resolve_service_type"] = f"""WITH v AS (
  SELECT p_partkey AS value_id,
    CASE p_partkey % 7 WHEN 0 THEN 'Stump grinding' WHEN 1 THEN 'stump_grinding' WHEN 2 THEN 'ROOT-REMOVAL'
      WHEN 3 THEN ' treePruning ' WHEN 4 THEN 'Unknown or not listed' WHEN 5 THEN p_type ELSE p_name END AS value
  FROM part)
SELECT value_id, value, {_SID} AS service_type_id, {_SLABEL} AS service_type_label FROM v"""


# ----------------------------------------------------------------- claims
RECEIVED_CTE = f"""received AS (
  SELECT event_id AS delivery_id, user_id * {dt.EMAIL_ID_STRIDE} AS email_id, ts AS received_at,
         event_type <> 'error' AS ok
  FROM events WHERE event_type <> 'view')"""

CLAIMS_CTES = f"""{RECEIVED_CTE},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY email_id ORDER BY received_at, delivery_id) AS rn FROM received),
walk AS (
  SELECT email_id, rn, delivery_id, received_at, ok,
         CASE WHEN ok THEN 'processed' ELSE 'released' END AS status,
         CAST(NULL AS VARCHAR) AS existing_status,
         CASE WHEN ok THEN received_at + INTERVAL 7 DAY END AS expires_at,
         CASE WHEN ok THEN received_at + INTERVAL 7 DAY END AS blocked_until
  FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.email_id, r.rn, r.delivery_id, r.received_at, r.ok,
         CASE WHEN w.blocked_until > r.received_at THEN 'skipped' WHEN r.ok THEN 'processed' ELSE 'released' END,
         CASE WHEN w.blocked_until > r.received_at THEN 'processed' END,
         CASE WHEN w.blocked_until > r.received_at THEN w.blocked_until
              WHEN r.ok THEN r.received_at + INTERVAL 7 DAY END,
         CASE WHEN w.blocked_until > r.received_at THEN w.blocked_until
              WHEN r.ok THEN r.received_at + INTERVAL 7 DAY END
  FROM walk w JOIN ranked r ON r.email_id = w.email_id AND r.rn = w.rn + 1)"""

ORACLE["claim_deliveries"] = f"""WITH RECURSIVE {CLAIMS_CTES}
SELECT delivery_id, email_id, status, existing_status,
       strftime(expires_at, '%Y-%m-%d %H:%M:%S.%f') AS expires_at
FROM walk"""


# ------------------------------------------------------------- O5, O6
from ..operators.inference import KEYWORDS, QUOTE_WORDS  # noqa: E402
from ..operators.requests import (DEFAULT_SELF_HOSTED_BASE_URL, DEFAULT_SELF_HOSTED_MAX_TOKENS,  # noqa: E402
                                  DEFAULT_SELF_HOSTED_MODEL, PROMPT_BODY_LABEL, prompt_head)


def utf16len(x: str) -> str:
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


PROMPT_SQL = f"({lit(prompt_head())} || subject || {lit(PROMPT_BODY_LABEL)} || body)"
ACCEPTED = "(SELECT * FROM sanitized WHERE subject IS NOT NULL AND body IS NOT NULL AND subject <> '' AND body <> '')"

ORACLE["build_requests"] = f"""WITH {SANITIZED_CTES}
SELECT email_id, md5({PROMPT_SQL}) AS prompt_md5, {utf16len(PROMPT_SQL)} AS prompt_length,
  'self-hosted' AS provider, {q(DEFAULT_SELF_HOSTED_MODEL)} AS model, {q(DEFAULT_SELF_HOSTED_BASE_URL)} AS base_url,
  CAST({DEFAULT_SELF_HOSTED_MAX_TOKENS} AS INTEGER) AS max_tokens, 'json_object' AS payload_mode,
  '{{"response_format":{{"type":"json_object"}},"think":false}}' AS response_format
FROM {ACCEPTED}"""


def keyword_cte(name: str, src: str, keep: str) -> str:
    def any_of(words):
        return "(" + " OR ".join(f"contains(lt, {q(w)})" for w in words) + ")"
    sid = "CASE " + " ".join(f"WHEN {any_of(ws)} THEN {q(t)}" for t, ws in KEYWORDS.items()) + " ELSE 'unknown' END"
    return f"""{name}_a AS (
  SELECT {keep}, {sid} AS sid, {any_of(QUOTE_WORDS)} AS quote
  FROM (SELECT *, lower(subject || chr(10) || body) AS lt FROM {src})),
{name} AS (
  SELECT *, sid <> 'unknown' AND quote AS alert,
    CASE WHEN quote AND sid <> 'unknown' THEN 0.9 WHEN sid <> 'unknown' THEN 0.5 WHEN quote THEN 0.3 ELSE 0.1 END AS score,
    CASE WHEN quote THEN 'The sender asks for a quote.' ELSE 'The sender does not ask for a quote.' END AS expl,
    CASE WHEN sid <> 'unknown' AND quote THEN 'Quote request for a listed service.'
         ELSE 'Not an actionable quote request for a listed service.' END AS reason
  FROM {name}_a)"""


ORACLE["classify"] = f"""WITH {SANITIZED_CTES},
{keyword_cte('kw', ACCEPTED, 'email_id, subject, body')}
SELECT email_id, 'keyword' AS response_provider, 'stop' AS stop_reason,
  '{{"explanation":"' || expl || '","serviceTypeId":"' || sid || '","confidenceScore":' || CAST(score AS VARCHAR)
    || ',"shouldAlertAdmin":' || CASE WHEN alert THEN 'true' ELSE 'false' END || ',"alertReason":"' || reason || '"}}'
    AS answer,
  CAST(ceil({utf16len(PROMPT_SQL)} / 4) AS BIGINT) AS input_tokens
FROM kw"""

# ------------------------------------------------------- O12, O13, O16, O17
_LABEL_OF_SID = "CASE service_type_id " + " ".join(
    f"WHEN {q(t['id'])} THEN {q(t['label'])}" for t in SERVICE_TYPES) + " END"

ORACLE["alert_gate"] = f"""WITH {FALLBACK_CTES}
SELECT run_id, CASE WHEN should_alert_admin THEN 'alert' ELSE 'quiet' END AS route FROM final"""


def _field(x: str) -> str:
    cut = f"substring(coalesce({x}, ''), 1, 1024)"
    return f"CASE WHEN {cut} = '' THEN 'N/A' ELSE {cut} END"


ORACLE["build_notifications"] = f"""WITH {FALLBACK_CTES},
{EMAILS_CTE}
SELECT e.email_id, 'discord' AS channel, 'New estimate request received' AS title,
  CAST(json_object('content', '**New estimate request received**',
    'embeds', json_array(json_object('title', 'Details', 'fields', json_array(
       json_object('name', 'customerEmail', 'value', {_field('e."from"')}, 'inline', false),
       json_object('name', 'emailSubject', 'value', {_field('e.subject')}, 'inline', false),
       json_object('name', 'serviceType', 'value', {_field(_LABEL_OF_SID)}, 'inline', false),
       json_object('name', 'summary', 'value', {_field('f.explanation')}, 'inline', false)),
     'timestamp', '2024-01-01T00:00:00.000Z'))) AS VARCHAR) AS body_json
FROM final f JOIN emails e ON e.email_id = f.run_id
WHERE f.should_alert_admin"""

ORACLE["route_notifications"] = f"""WITH sent AS ({ORACLE["build_notifications"]})
SELECT email_id, CASE WHEN email_id % 3 = 0 THEN channel END AS channel,
  CASE WHEN email_id % 3 = 0 THEN md5(body_json) END AS body_md5,
  CASE email_id % 3 WHEN 1 THEN 'Unsupported notification channel: sms'
                    WHEN 2 THEN 'Unsupported notification channel: null' END AS error_message
FROM (SELECT email_id, channel, body_json FROM sent
      UNION ALL SELECT run_id, NULL, NULL FROM (SELECT run_id, route FROM ({ORACLE["alert_gate"]})
        WHERE route = 'alert' AND run_id % 3 > 0 AND run_id NOT IN (SELECT email_id FROM sent)))"""

ORACLE["filter_events"] = """SELECT type, type = 'email.received' AS kept, count(*) AS n
FROM (SELECT CASE event_type WHEN 'view' THEN 'email.opened' ELSE 'email.received' END AS type FROM events)
GROUP BY ALL"""

ORACLE["attach_email"] = f"""WITH {EMAILS_CTE}, {RECEIVED_CTE}
SELECT r.delivery_id, r.email_id,
  CASE WHEN e.email_id IS NULL THEN 'The mail service did not return email data' END AS error_message,
  {utf16len('e.subject')} AS subject_length
FROM received r LEFT JOIN emails e ON e.email_id = r.email_id"""

# ------------------------------------------------------------------ P1, P3
# identical prompts share the recording of the smallest email id
P1_ANSWERS = answers_cte(
    "p1ans", f"(SELECT *, min(email_id) OVER (PARTITION BY subject, body) AS rec_id FROM {ACCEPTED})",
    "rec_id", "body", "email_id")
P1_CTES = f"""{SANITIZED_CTES},
recs AS (SELECT email_id, min(email_id) OVER (PARTITION BY subject, body) AS rec_id FROM {ACCEPTED}),
{P1_ANSWERS},
{validate_ctes("(SELECT *, true AS is_text FROM p1ans)", "email_id", name="p1chk")},
outcome AS (SELECT email_id, len(issues) = 0 AS valid, sid, score, alert FROM p1chk),
fin_ AS (SELECT email_id, valid, CASE WHEN valid THEN sid ELSE 'unknown' END AS sid,
  CASE WHEN valid THEN score ELSE 0.0 END AS score, valid AND alert AS alert FROM outcome),
{RECEIVED_CTE.replace("received AS (", "received0 AS (")},
received AS (
  SELECT r.delivery_id, r.email_id, r.received_at, r.ok AND o.email_id IS NOT NULL AS ok
  FROM received0 r LEFT JOIN outcome o USING (email_id)),
{CLAIMS_CTES[CLAIMS_CTES.index("ranked AS"):]}"""

ORACLE["triage_batch"] = f"""WITH RECURSIVE {P1_CTES}
SELECT w.delivery_id, w.email_id, w.status, w.existing_status,
  strftime(w.expires_at, '%Y-%m-%d %H:%M:%S.%f') AS expires_at,
  CASE WHEN w.status = 'processed' THEN o.sid END AS service_type_id,
  CASE WHEN w.status = 'processed' THEN o.alert END AS should_alert_admin,
  CASE WHEN w.status = 'processed' THEN NOT o.valid END AS fallback
FROM walk w LEFT JOIN fin_ o USING (email_id)"""

_LABEL = "CASE f.sid " + " ".join(f"WHEN {q(t['id'])} THEN {q(t['label'])}" for t in SERVICE_TYPES) + " END"
_NO_PERSON = "'$process_person_profile=false'"
_DOUBLE = "CASE WHEN f.score = floor(f.score) THEN CAST(CAST(f.score AS BIGINT) AS VARCHAR) || '.0' ELSE CAST(f.score AS VARCHAR) END"
EVENT_CASES = """ecase AS (
  SELECT d.doc_id AS case_no, split_part(d.text, chr(10), 1) AS subject, d.text AS body
  FROM labels l JOIN documents d USING (doc_id))"""
ORACLE["lifecycle_events"] = f"""WITH RECURSIVE {P1_CTES},
{EVENT_CASES},
{keyword_cte('ekw', f"(SELECT * FROM ecase WHERE {trim_js('subject')} <> '' AND {trim_js('body')} <> '')", 'case_no')},
done AS (SELECT w.email_id, f.* EXCLUDE (email_id) FROM walk w JOIN fin_ f USING (email_id) WHERE w.status = 'processed'),
ev AS (
  SELECT 'inbound_email_received' AS event, {_NO_PERSON} AS properties, CAST(email_id AS VARCHAR) AS id FROM received
  UNION ALL SELECT 'email_processing_skipped', {_NO_PERSON} || '|existing_status=' || existing_status,
    CAST(email_id AS VARCHAR) FROM walk WHERE status = 'skipped'
  UNION ALL SELECT 'email_categorized', {_NO_PERSON} || '|confidence_score=' || {_DOUBLE} || '|service_type_id=' || f.sid
    || '|service_type_label=' || {_LABEL} || '|should_alert_admin=' || CAST(f.alert AS VARCHAR), CAST(email_id AS VARCHAR)
    FROM done f
  UNION ALL SELECT 'admin_alert_sent', {_NO_PERSON} || '|notification_channel=discord|service_type_id=' || f.sid
    || '|service_type_label=' || {_LABEL}, CAST(email_id AS VARCHAR) FROM done f WHERE f.alert
  UNION ALL SELECT 'categorizer_fallback_result', {_NO_PERSON} || '|has_model_error='
    || CASE WHEN r.rec_id % 9 = 0 THEN 'true' ELSE 'false' END
    || '|model_id=gpt-4o-mini|provider=openai|source=inbound_email|stop_reason='
    || CASE WHEN r.rec_id % 9 = 0 THEN 'error' ELSE 'stop' END, 'email-triage'
    FROM done f JOIN recs r USING (email_id) WHERE NOT f.valid
  UNION ALL SELECT 'eval_email_categorized', {_NO_PERSON} || '|confidence_score=' || CAST(score AS VARCHAR)
    || '|service_type_id=' || sid || '|should_alert_admin=' || CAST(alert AS VARCHAR), 'email-triage' FROM ekw)
SELECT event, properties, count(*) AS n, count(DISTINCT id) AS n_ids FROM ev GROUP BY ALL"""

ORACLE["quarantine"] = f"""WITH RECURSIVE {P1_CTES},
rejected AS (SELECT email_id FROM sanitized WHERE subject IS NULL OR body IS NULL OR subject = '' OR body = '')
SELECT CASE WHEN e.email_id IS NULL THEN 'fetch' WHEN r.email_id IS NOT NULL THEN 'prompt' ELSE 'delivery' END AS stage,
  CAST(w.email_id AS VARCHAR) AS email_id, CAST(w.delivery_id AS VARCHAR) AS delivery_id,
  CASE WHEN e.email_id IS NULL THEN 'The mail service did not return email data'
       WHEN r.email_id IS NOT NULL THEN {q(INBOUND_REJECT_REASON)}
       ELSE 'The delivery failed after its mail was categorized' END AS error_message
FROM walk w LEFT JOIN emails e USING (email_id) LEFT JOIN rejected r USING (email_id) WHERE w.status = 'released'
UNION ALL
SELECT 'model', CAST(d.doc_id AS VARCHAR), NULL, 'Unknown categorizer model configuration'
FROM labels l JOIN documents d USING (doc_id)
WHERE {trim_js(f'split_part(d.text, {NL}, 1)')} <> '' AND {trim_js('d.text')} <> ''"""

ORACLE["result_store"] = f"""WITH RECURSIVE {P1_CTES}
SELECT w.delivery_id, w.email_id, o.sid AS service_type_id, o.score AS confidence_score,
  o.alert AS should_alert_admin, NOT o.valid AS fallback, md5(s.subject) AS subject_md5, md5(s.body) AS body_md5,
  CAST(CAST(w.received_at AS DATE) AS VARCHAR) AS dt
FROM walk w JOIN fin_ o USING (email_id) JOIN sanitized s USING (email_id) WHERE w.status = 'processed'"""

CASES_CTE = """cases AS (
  SELECT d.doc_id AS case_no, split_part(d.text, chr(10), 1) AS subject, d.text AS body
  FROM labels l JOIN documents d USING (doc_id))"""

ORACLE["categorize_table"] = f"""WITH {CASES_CTE},
{keyword_cte('kw', f"(SELECT * FROM cases WHERE {trim_js('subject')} <> '' AND {trim_js('body')} <> '')", 'case_no')}
SELECT case_no, sid AS service_type_id, score AS confidence_score, alert AS should_alert_admin,
  false AS fallback,
  CASE sid {" ".join(f"WHEN {q(t['id'])} THEN {q(t['label'])}" for t in SERVICE_TYPES)} END AS service_type_label
FROM kw"""


# ------------------------------------------------------------ O18, O24
META_CTE = f"""meta AS (
  SELECT run_id, count(*) AS content_block_count, sum(length(text)) AS chars,
    ['openai', 'anthropic', 'self-hosted'][run_id % 3 + 1] AS provider,
    ['gpt-4o-mini', 'claude-haiku-4-5', 'gemma4:e4b'][run_id % 3 + 1] AS model,
    CASE WHEN run_id % 5 = 0 THEN ['gpt-4o-mini-2024-07-18', 'claude-haiku-4-5-20251001', 'gemma4:e4b'][run_id % 3 + 1] END
      AS response_model,
    CASE WHEN run_id % 9 = 0 THEN 'error' ELSE 'stop' END AS stop_reason,
    CASE WHEN run_id % 9 = 0 THEN 'upstream timeout' END AS error_message
  FROM blocks_t GROUP BY run_id)"""

TELEMETRY_CTES = f"""{FALLBACK_CTES},
{SANITIZED_CTES},
{META_CTE},
tel AS (
  SELECT f.run_id, 'categorizer' AS feature_name,
    CASE WHEN f.run_id % 2 = 0 THEN 'eval_endpoint' ELSE 'inbound_email' END AS source,
    m.provider, m.model AS request_model,
    CASE WHEN m.provider = 'self-hosted' THEN 'localhost:11434' END AS base_url_host,
    {utf16len('s.subject')} AS subject_length, {utf16len('s.body')} AS body_length,
    m.provider AS response_provider, coalesce(m.response_model, m.model) AS response_model, m.stop_reason,
    m.content_block_count,
    m.stop_reason = 'error' OR coalesce(m.error_message <> '', false) AS model_error,
    900 + f.run_id % 100 AS input_tokens, CAST(ceil(m.chars / 4) AS BIGINT) AS output_tokens,
    CAST(0 AS BIGINT) AS cache_read_tokens, CAST(0 AS BIGINT) AS cache_write_tokens,
    900 + f.run_id % 100 + CAST(ceil(m.chars / 4) AS BIGINT) AS total_tokens,
    round(CASE WHEN f.run_id % 3 = 2 THEN 0.0
         ELSE ((900 + f.run_id % 100) * CAST(0.15 AS DOUBLE) + CAST(ceil(m.chars / 4) AS BIGINT) * CAST(0.6 AS DOUBLE)) / 1e6
         END, 9) AS cost_usd,
    f.service_type_id, f.confidence_score, f.should_alert_admin,
    {utf16len('f.explanation')} AS explanation_length, {utf16len('f.alert_reason')} AS alert_reason_length,
    w.n_parse_errors > 0 AS parse_error, false AS prompt_error, f.fallback
  FROM final f JOIN meta m USING (run_id) JOIN winners w USING (run_id)
  LEFT JOIN sanitized s ON s.email_id = f.run_id)"""

ORACLE["run_telemetry"] = f"""WITH {TELEMETRY_CTES}
SELECT * FROM tel"""

ORACLE["usage_rollup"] = f"""WITH {TELEMETRY_CTES}
SELECT provider, request_model, source,
  date_trunc('hour', make_timestamp((1704067200 + run_id * 60) * 1000000)) AS bucket, count(*) AS runs,
  CAST(sum(CAST(model_error AS INT)) AS BIGINT) AS model_errors,
  CAST(sum(CAST(parse_error AS INT)) AS BIGINT) AS parse_errors,
  CAST(sum(CAST(fallback AS INT)) AS BIGINT) AS fallbacks,
  CAST(sum(CAST(should_alert_admin AS INT)) AS BIGINT) AS alerts,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(cost_usd), 9) AS cost_usd,
  avg(CAST(run_id % 30 AS DOUBLE)) AS avg_latency_s
FROM tel GROUP BY ALL"""

_USAGE_TEL = """SELECT *, date_trunc('hour', make_timestamp((1704067200 + run_id * 60) * 1000000)) AS bucket,
    CAST(run_id % 30 AS DOUBLE) AS latency FROM tel"""
_USAGE_SUMS = """count(*) AS runs,
  CAST(sum(CAST(model_error AS INT)) AS BIGINT) AS model_errors,
  CAST(sum(CAST(parse_error AS INT)) AS BIGINT) AS parse_errors,
  CAST(sum(CAST(fallback AS INT)) AS BIGINT) AS fallbacks,
  CAST(sum(CAST(should_alert_admin AS INT)) AS BIGINT) AS alerts,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(cost_usd), 9) AS cost_usd"""

ORACLE["usage_levels"] = f"""WITH {TELEMETRY_CTES}, u AS ({_USAGE_TEL})
SELECT provider, request_model, source, bucket,
  CAST(4 - grouping(provider) - grouping(request_model) - grouping(source) - grouping(bucket) AS INT) AS level,
  {_USAGE_SUMS}, count(latency) AS n_latencies
FROM u GROUP BY ROLLUP (provider, request_model, source, bucket)"""

ORACLE["usage_rollup_stream"] = f"""WITH {TELEMETRY_CTES}, u AS ({_USAGE_TEL})
SELECT provider, request_model, source, bucket, {_USAGE_SUMS}, avg(latency) AS avg_latency_s,
  quantile_disc(latency, 0.5) AS p50_latency_s, quantile_disc(latency, 0.95) AS p95_latency_s
FROM u WHERE bucket + INTERVAL 1 HOUR <= make_timestamp((1704067200 + (SELECT max(run_id) FROM tel) * 60) * 1000000)
GROUP BY provider, request_model, source, bucket"""

# ------------------------------------------------------- O21-O23, O25, O26
from ..operators.evaluate import DEFAULT_THRESHOLDS, NUMERIC_TEXT, PROVIDERS  # noqa: E402

PROVIDERS_VALUES = ", ".join(
    f"({i}, {q(p['id'])}, {q(p['label'])}, {'NULL' if p['max_tokens'] is None else p['max_tokens']})"
    for i, p in enumerate(PROVIDERS))
CASE_IDS = "[" + ", ".join(q(t["id"]) for t in SERVICE_TYPES) + "]"

ECASES_CTE = f"""ecases AS (
  SELECT d.doc_id AS case_no, d.lang AS path_type, split_part(d.text, chr(10), 1) AS subject, d.text AS body,
    CASE WHEN d.doc_id % 11 = 0 THEN 'stumpRemoval,rootRemoval' WHEN d.doc_id % 11 = 1 THEN ' , ' END AS ids_plural,
    CASE WHEN d.doc_id % 11 NOT IN (0, 1) THEN {CASE_IDS}[d.doc_id % 5 + 1] END AS id_single,
    CASE WHEN l.toxic = 1 THEN ' maybe ' WHEN l.quality = 1 THEN ' TRUE' ELSE 'false' END AS notify_s,
    CASE WHEN l.quality = 1 THEN CASE WHEN d.doc_id % 4 = 0 THEN '0.55' ELSE '0.7' END END AS min_s,
    CASE WHEN l.quality = 0 THEN CASE WHEN d.doc_id % 4 = 1 THEN ' ' ELSE '0.3' END END AS max_s
  FROM labels l JOIN documents d USING (doc_id)),
providers AS (SELECT * FROM (VALUES {PROVIDERS_VALUES}) p(provider_ord, provider_id, provider_label, max_tokens))"""


def number_text(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


def as_number_sql(x: str) -> str:
    t = trim_js(x)
    return (f"CASE WHEN {x} IS NULL OR {x} = '' THEN NULL WHEN {t} = '' THEN 0.0 "
            f"WHEN regexp_matches({t}, {q(NUMERIC_TEXT)}) THEN CAST({t} AS DOUBLE) END")


EKEEP = "case_no, provider_id, provider_ord, path_type, ids_plural, id_single, notify_s, min_s, max_s"
def verdict_ctes(run: bool = False) -> str:
    """The verdicts of every (case, provider).  In an eval run a call without
    a recording (seed divisible by 17) gives no output and no usage, and the
    input tokens follow the prompt."""
    keep = EKEEP + (", n_prompt, rec_no" if run else "")
    seed = "rec_no * 10 + provider_ord" if run else "case_no * 10 + provider_ord"
    prompt = f"({lit(prompt_head())} || subject || {lit(PROMPT_BODY_LABEL)} || body)"
    extra = (f", length({prompt}) AS n_prompt, min(case_no) OVER (PARTITION BY subject, body) AS rec_no" if run else "")
    failed = f"({seed}) % 17 = 0" if run else "false"
    n_in = "CAST(ceil(n_prompt / 4) AS BIGINT)" if run else "900 + case_no % 100"
    return f"""{ECASES_CTE},
mx AS (SELECT c.*, p.provider_ord, p.provider_id{extra} FROM ecases c CROSS JOIN providers p),
{answers_cte("evans", "mx", seed, "body", keep)},
{validate_ctes(f"(SELECT * REPLACE (CASE WHEN {failed} THEN '' ELSE text END AS text) FROM evans)", keep + ", text", name="evchk")},
evs AS (
  SELECT *,
    CASE lower({trim_js('notify_s')}) WHEN 'true' THEN true WHEN 'false' THEN false END AS exp_notify,
    CASE WHEN ids_plural IS NOT NULL AND {trim_js('ids_plural')} <> ''
           THEN list_filter(list_transform(string_split(ids_plural, ','), lambda x: {trim_js('x')}), lambda x: x <> '')
         WHEN id_single IS NOT NULL AND {trim_js('id_single')} <> '' THEN [{trim_js('id_single')}]
         ELSE CAST([] AS VARCHAR[]) END AS exp_ids,
    {as_number_sql('min_s')} AS min_c, {as_number_sql('max_s')} AS max_c,
    NOT ((starts_with(w0, '{{') AND ends_with(w0, '}}'))
         OR (strpos(w0, '{{') > 0 AND strpos(reverse(w0), '}}') > 0
             AND length(w0) - strpos(reverse(w0), '}}') + 1 > strpos(w0, '{{'))) AS nobrace,
    coalesce(t_score IN {NUMBER_TYPES}, false) AS num,
    {failed} AS failed, CASE WHEN NOT {failed} THEN {n_in} END AS n_in, CAST(ceil(length(text) / 4) AS BIGINT) AS n_out
  FROM evchk),
evf AS (
  SELECT *, (NOT nobrace AND j IS NOT NULL AND root = 'OBJECT') AS parsed,
    CAST(
      CAST(NOT coalesce(t_expl = 'VARCHAR' AND expl <> '', false) AS INT)
    + CAST(NOT coalesce(t_sid = 'VARCHAR' AND sid IN {ENUM}, false) AS INT)
    + CAST(NOT coalesce(num AND score >= 0 AND score <= 1, false) AS INT)
    + CAST(NOT coalesce(t_alert = 'BOOLEAN', false) AS INT)
    + CAST(NOT coalesce(t_reason = 'VARCHAR' AND reason <> '', false) AS INT)
    + CAST(exp_notify IS NULL AS INT)
    + CAST(coalesce(exp_notify IS NOT NULL AND t_alert = 'BOOLEAN' AND alert <> exp_notify, false) AS INT)
    + CAST(coalesce(len(exp_ids) > 0 AND NOT coalesce(t_sid = 'VARCHAR' AND list_contains(exp_ids, sid), false), false) AS INT)
    + CAST(coalesce(min_c IS NOT NULL AND num AND score < min_c, false) AS INT)
    + CAST(coalesce(max_c IS NOT NULL AND num AND score > max_c, false) AS INT) AS BIGINT) AS n_failures,
    CAST(6 + CAST(exp_notify IS NOT NULL AS INT) + CAST(len(exp_ids) > 0 AS INT) + CAST(min_c IS NOT NULL AS INT)
      + CAST(max_c IS NOT NULL AS INT) AS BIGINT) AS n_checks,
    n_in + n_out AS total_tokens,
    CASE WHEN failed THEN NULL WHEN provider_id LIKE 'ollama%' THEN 0.0
         ELSE (n_in * CAST(0.15 AS DOUBLE) + n_out * CAST(0.6 AS DOUBLE)) / 1e6 END AS cost_usd
  FROM evs),
verdicts AS (
  SELECT *, parsed AND n_failures = 0 AS pass,
    CASE WHEN NOT parsed THEN 'Output must be a JSON object.'
         WHEN n_failures = 0 THEN 'Parsed ' || sid || ' at confidence ' || {number_text('score')} || '; shouldAlertAdmin='
           || CAST(alert AS VARCHAR)
         ELSE array_to_string(list_filter([
           CASE WHEN NOT coalesce(t_expl = 'VARCHAR' AND expl <> '', false) THEN 'explanation must be a non-empty string' END,
           CASE WHEN NOT coalesce(t_sid = 'VARCHAR' AND sid IN {ENUM}, false)
                THEN {q('serviceTypeId must be one of ' + ', '.join(SERVICE_IDS))} END,
           CASE WHEN NOT coalesce(num AND score >= 0 AND score <= 1, false)
                THEN 'confidenceScore must be a number between 0 and 1' END,
           CASE WHEN NOT coalesce(t_alert = 'BOOLEAN', false) THEN 'shouldAlertAdmin must be a boolean' END,
           CASE WHEN NOT coalesce(t_reason = 'VARCHAR' AND reason <> '', false) THEN 'alertReason must be a non-empty string' END,
           CASE WHEN exp_notify IS NULL THEN 'expectedShouldNotify test variable must be true or false' END,
           CASE WHEN exp_notify IS NOT NULL AND t_alert = 'BOOLEAN' AND alert <> exp_notify
                THEN 'expected shouldAlertAdmin ' || CAST(exp_notify AS VARCHAR) || ', got ' || CAST(alert AS VARCHAR) END,
           CASE WHEN len(exp_ids) > 0 AND NOT coalesce(t_sid = 'VARCHAR' AND list_contains(exp_ids, sid), false)
                THEN 'expected serviceTypeId ' || array_to_string(exp_ids, ' or ') || ', got ' || coalesce(sid, 'undefined') END,
           CASE WHEN min_c IS NOT NULL AND num AND score < min_c
                THEN 'expected confidenceScore >= ' || {number_text('min_c')} || ', got ' || {number_text('score')} END,
           CASE WHEN max_c IS NOT NULL AND num AND score > max_c
                THEN 'expected confidenceScore <= ' || {number_text('max_c')} || ', got ' || {number_text('score')} END],
           lambda x: x IS NOT NULL), '; ') END AS vreason,
    CASE WHEN parsed THEN greatest(0.0, CAST(n_checks - n_failures AS DOUBLE) / n_checks) ELSE 0.0 END AS vscore,
    len(issues) = 0 AS contract_pass,
    CASE WHEN parsed AND t_sid = 'VARCHAR' AND sid IN {ENUM} AND sid <> 'unknown' AND num THEN score END AS eligible_score
  FROM evf)"""


VERDICT_CTES = verdict_ctes()

ORACLE["eval_matrix"] = f"""WITH {ECASES_CTE}
SELECT c.case_no, p.provider_id, p.provider_label, CAST(p.max_tokens AS INTEGER) AS max_tokens
FROM ecases c CROSS JOIN providers p"""

ORACLE["score_cases"] = f"""WITH {VERDICT_CTES}
SELECT case_no, provider_id, pass, vscore AS score, n_failures, n_checks, contract_pass, vreason AS reason FROM verdicts"""

SUMMARY_AGGS = """count(*) AS cases, CAST(sum(CAST(pass AS INT)) AS BIGINT) AS passes,
  round(avg(CAST(pass AS DOUBLE)), 9) AS pass_rate, round(avg(vscore), 9) AS avg_score,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(cost_usd), 9) AS cost_usd,
  CAST(sum(CAST(pass AND NOT contract_pass AS INT)) AS BIGINT) AS eval_pass_contract_fail"""

ORACLE["eval_summary"] = f"""WITH {VERDICT_CTES}
SELECT provider_id, {SUMMARY_AGGS} FROM verdicts GROUP BY provider_id"""

ORACLE["eval_buckets"] = f"""WITH {VERDICT_CTES}
SELECT path_type, provider_id, {SUMMARY_AGGS} FROM verdicts GROUP BY ROLLUP (path_type, provider_id)"""
ORACLE["eval_buckets"] = ORACLE["eval_buckets"].replace(
    "SELECT path_type, provider_id,", """SELECT path_type, provider_id,
  CASE WHEN grouping(path_type) = 1 THEN 'all' WHEN grouping(provider_id) = 1 THEN 'bucket' ELSE 'provider' END AS level,""")

ORACLE["eval_run"] = f"""WITH {verdict_ctes(run=True)}
SELECT provider_id, {SUMMARY_AGGS}, CAST(sum(CAST(failed AS INT)) AS BIGINT) AS failed_calls
FROM verdicts GROUP BY provider_id"""

THRESHOLDS_VALUES = ", ".join(f"(CAST({t} AS DOUBLE))" for t in DEFAULT_THRESHOLDS)
ORACLE["gate_sweep"] = f"""WITH {VERDICT_CTES},
th AS (SELECT * FROM (VALUES {THRESHOLDS_VALUES}) t(threshold)),
g AS (SELECT th.threshold, coalesce(v.eligible_score > th.threshold, false) AS el, v.exp_notify AS ex
      FROM verdicts v CROSS JOIN th WHERE v.exp_notify IS NOT NULL)
SELECT threshold,
  CAST(sum(CAST(el AND ex AS INT)) AS BIGINT) AS tp, CAST(sum(CAST(el AND NOT ex AS INT)) AS BIGINT) AS fp,
  CAST(sum(CAST(NOT el AND NOT ex AS INT)) AS BIGINT) AS tn, CAST(sum(CAST(NOT el AND ex AS INT)) AS BIGINT) AS fn
FROM g GROUP BY threshold"""

ORACLE["claim_deliveries_stream"] = ORACLE["claim_stream"] = ORACLE["claim_deliveries"]
ORACLE["triage_stream"] = ORACLE["triage_batch"]

ORACLE["triage_summary"] = f"""WITH {SANITIZED_CTES},
{P1_ANSWERS},
{validate_ctes("(SELECT *, true AS is_text FROM p1ans)", "email_id", name="p1chk")}
SELECT CASE WHEN len(issues) = 0 THEN sid ELSE 'unknown' END AS service_type_id,
  CASE WHEN len(issues) = 0 THEN alert ELSE false END AS should_alert_admin, count(*) AS n_mails
FROM p1chk GROUP BY ALL"""
