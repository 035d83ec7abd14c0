"""SQL for the queries that it can express: what chat formatting reads back, and the components of near copies."""

from __future__ import annotations

from weirflow.llm import chat

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def chat_sql(template: chat.Template, extra: list[tuple]) -> str:
    """SQL for read_back(format_turns(conversations and the extra rows))."""

    def escaped(column: str) -> str:
        out = f"replace({column}, '\\', '\\\\')"
        for c in template.controls():
            out = f"replace({out}, {_quoted(c)}, {_quoted(c[0] + chr(92) + c[1:])})"
        return out

    cases, losses, steps = [], [], []
    for role, t in template.turns.items():
        cases.append(f"WHEN role = {_quoted(role)} THEN {_quoted(t.opening)} || esc || {_quoted(t.closing)}")
        if t.loss:
            losses.append(role)
    other = f"{_quoted(template.other.opening)} || {escaped('role')} || {_quoted(template.name_end)} || esc || {_quoted(template.other.closing)}"
    for state, following in template.arrows.items():
        steps += [f"(before = {_quoted(state)} AND role = {_quoted(f)})" for f in following]
    loss = f"role IN ({', '.join(map(_quoted, losses))})"
    rows = " ".join(f"UNION ALL SELECT {c}, {t}, {_quoted(r)}, {_quoted(x)}" for c, t, r, x in extra)
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
WITH given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations {rows}),
numbered AS (SELECT *, {escaped("text")} AS esc, coalesce(lag(role) OVER (PARTITION BY conv_id {order}), 'start') AS before FROM given),
written AS (SELECT *, CASE {" ".join(cases)} ELSE {other} END AS formatted FROM numbered)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
       coalesce(sum(length(text)) FILTER ({loss}), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' {order}) FILTER ({loss}), '')) AS loss_sha256,
       sum(length(formatted))::BIGINT AS formatted_chars, sha256(string_agg(formatted, '' {order})) AS formatted_sha256, bool_and({" OR ".join(steps)}) AS in_order
FROM written GROUP BY conv_id
"""


NEAR_COPIES_SQL = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM worded),
shingles AS (SELECT doc_id, unnest(s) AS x FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * k >= 75 * (len(p.s) + len(q.s) - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.a, l.b FROM reached r JOIN both_ways l ON r.b = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) r ON r.a = s.doc_id
"""


def licenses_sql(least: float, given: list[tuple[str, str]]) -> str:
    """SQL for licenses.scan() over the documents as files /source/lang/doc_id: from the templates' texts on, every unit against every template."""
    values = ", ".join(f"({i}, {_quoted(name)}, {_quoted(text)})" for i, (name, text) in enumerate(given))
    terms = "list_filter(list_transform(regexp_split_to_array(lower({0}), '[^a-z0-9.+-]+'), lambda x: trim(x, '.+-')), lambda x: x <> '')"
    return f"""
WITH templates(template, licence, text) AS (VALUES {values}),
template_terms AS (SELECT template, licence, unnest({terms.format("text")}) AS term FROM templates),
files AS (SELECT doc_id, '/' || coalesce(source, '-') || '/' || coalesce(lang, '-') AS dir, coalesce(text, '') AS text FROM documents),
said AS (SELECT DISTINCT doc_id, unnest({terms.format("text")}) AS term FROM files),
n AS (SELECT count(*) AS n FROM files),
idfs AS (
  SELECT term, ln((1 + any_value(n.n)) / (1 + count(said.doc_id))::DOUBLE) + 1 AS idf
  FROM (SELECT DISTINCT term FROM template_terms) t LEFT JOIN said USING (term) CROSS JOIN n GROUP BY term),
weights AS (
  SELECT template, licence, term, count(*) * any_value(idf) AS w, sqrt(sum(count(*) * any_value(idf) * count(*) * any_value(idf)) OVER (PARTITION BY template)) AS norm
  FROM template_terms JOIN idfs USING (term) GROUP BY template, licence, term),
units AS (
  SELECT doc_id, 0 AS kind, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10))) AS part FROM files
  UNION ALL SELECT doc_id, 1, unnest(regexp_split_to_array(text, '\\n[^a-zA-Z0-9\\n]*\\n')) FROM files
  UNION ALL SELECT doc_id, 2, text FROM files),
placed AS (SELECT *, row_number() OVER () AS place FROM units),
tf AS (
  SELECT t.*, k * coalesce(idf, ln((1 + n.n) / 2::DOUBLE) + 1) AS w
  FROM (SELECT doc_id, kind, place, term, count(*) AS k FROM (SELECT doc_id, kind, place, unnest({terms.format("part")}) AS term FROM placed) GROUP BY ALL) t LEFT JOIN idfs USING (term) CROSS JOIN n),
norms AS (SELECT place, sqrt(sum(w * w)) AS norm FROM tf GROUP BY place),
scored AS (
  SELECT tf.doc_id, kind, place, licence, round(sum(tf.w * weights.w / weights.norm) / any_value(norms.norm), 6) AS score
  FROM tf JOIN weights USING (term) JOIN norms USING (place) GROUP BY tf.doc_id, kind, place, template, licence),
best AS (SELECT * FROM scored WHERE score >= {least} QUALIFY row_number() OVER (PARTITION BY place ORDER BY score DESC, licence) = 1),
own AS (
  SELECT doc_id, first(licence ORDER BY score DESC, licence) AS own_license, max(score) AS own_score, count(*) FILTER (kind = 0) AS n_statements, bool_or(kind = 2) AS is_file FROM best GROUP BY doc_id),
speaking AS (SELECT dir AS ancestor, first(own_license ORDER BY own_score DESC, dir || '/' || doc_id) AS given FROM own JOIN files USING (doc_id) WHERE is_file GROUP BY dir),
above AS (SELECT d.dir, s.ancestor, s.given FROM (SELECT DISTINCT dir FROM files) d JOIN speaking s ON starts_with(d.dir || '/', s.ancestor || '/')),
nearest AS (SELECT * FROM above QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(ancestor) DESC) = 1)
SELECT f.doc_id, f.dir || '/' || f.doc_id AS path, own_license, own_score, coalesce(n_statements, 0)::BIGINT AS n_statements, coalesce(is_file, false) AS is_license_file,
       coalesce(own_license, given) AS license, CASE WHEN own_license IS NULL THEN ancestor END AS inherited_from
FROM files f LEFT JOIN own USING (doc_id) LEFT JOIN nearest n ON n.dir = f.dir
"""
