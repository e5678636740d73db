"""DuckDB SQL for the engine's queries."""

from __future__ import annotations

from parlance import queries as Q
from parlance.functions import lexicon as L
from parlance.operators import structure

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"
UNITS = "am|pm|AM|PM|%|dollars?|euros?|pounds?|hours?|minutes?|days?|weeks?"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def ordered(expr: str) -> str:
    """Distinct, in order of first occurrence."""
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def number_list(text: str) -> str:
    """Number matches without look-around: separators doubled, one consumed on each side."""
    doubled = rf"regexp_replace({text}, '([^\p{{L}}\p{{N}}_.,:$£€%])', '\1\1', 'g')"
    return rf"list_transform(regexp_extract_all({doubled}, '(?:^|[^\p{{L}}\p{{N}}_])((?:[$£€])?\s*\p{{Nd}}+(?:[.,:]\p{{Nd}}+)*(?:\s*(?:{UNITS}))?)(?:[^\p{{L}}\p{{N}}_]|$)', 1), lambda x: trim(replace(x, '  ', ' ')))"


def norm(x: str) -> str:
    return rf"replace(lower(regexp_replace({x}, '\s+', '', 'g')), ',', '')"


def cap_list(text: str) -> str:
    doubled = rf"regexp_replace({text}, '([^\p{{L}}\p{{N}}_''-])', '\1\1', 'g')"
    return rf"regexp_extract_all({doubled}, '(?:^|[^\p{{L}}\p{{N}}_])([A-Z][A-Za-z''-]{{0,29}}[A-Za-z])[''-]*(?:[^\p{{L}}\p{{N}}_]|$)', 1)"


def words(text: str) -> str:
    return f"regexp_extract_all({text}, '[A-Za-z][A-Za-z''-]*')"


def tokens(text: str) -> str:
    return rf"regexp_extract_all({text}, '\S+')"


def sentences(text: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({strip(text)}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {strip('x')}), lambda x: x <> '')"


DOCS = "docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
DIALOGUES = """dialogues AS (SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS dialogue FROM conversations GROUP BY conv_id)"""
NAME, VERB = listed(Q.NAMES), listed(Q.VERBS)
PAIRS = f"""items AS (SELECT l_orderkey AS o, list(struct_pack(ln := l_linenumber, nm := (l_linenumber % 5)::INT, vb := ((l_partkey + l_linenumber) % 4)::INT,
        q := trunc(l_quantity)::INT, h := (l_suppkey % 9 + 1)::INT) ORDER BY l_linenumber, (l_linenumber % 5), ((l_partkey + l_linenumber) % 4), trunc(l_quantity)::INT, (l_suppkey % 9 + 1)) AS t
      FROM lineitem GROUP BY l_orderkey),
told AS (SELECT o, t, list_transform(t, lambda x, i: (CASE WHEN o % 5 = 0 AND i = 1 THEN {NAME}[(x.nm + 1) % 5 + 1] ELSE {NAME}[x.nm + 1] END) || ' will ' || {VERB}[x.vb + 1] || ' '
        || (CASE WHEN o % 7 = 0 AND i = 1 THEN x.q + 1000 ELSE x.q END)::VARCHAR || {q(Q.UNITS)} || x.h::VARCHAR || ':00 PM') AS s FROM items),
pairs AS (SELECT o, array_to_string(list_transform(t, lambda x: {NAME}[x.nm + 1] || ': I will ' || {VERB}[x.vb + 1] || ' ' || x.q::VARCHAR || {q(Q.UNITS)} || x.h::VARCHAR || ':00 PM.'), chr(10)) AS dialogue,
        array_to_string(CASE WHEN o % 3 = 0 THEN s || s[1:1] ELSE s END, '. ') || (CASE WHEN o % 11 = 0 THEN '' ELSE '.' END) AS summary FROM told)"""
SPEAKERS = ordered("regexp_extract_all(dialogue, '(?m)^\\s*([A-Z][A-Za-z .''-]{0,39}?):', 1)")

IGNORED = listed(L.IGNORED)
#: Everything that reliability needs, per order: numbers, people, sentence pairs.
CHECKED = f"""{PAIRS},
base AS (SELECT o, dialogue, summary, {SPEAKERS} AS speakers, {ordered(number_list('dialogue'))} AS dn, {number_list('summary')} AS sn,
        list_transform({words('dialogue')}, lambda w: lower(w)) AS dw, {sentences('summary')} AS sents FROM pairs),
people AS (SELECT o, list_filter({cap_list('summary')}, lambda w: NOT list_contains({IGNORED}, w) AND NOT list_contains(dw, lower(w))) AS bad FROM base),
support AS (SELECT o, list_filter(sn, lambda x: NOT list_contains(list_transform(dn, lambda y: {norm('y')}), {norm('x')})) AS extra,
        list_filter(dn, lambda x: NOT list_contains(list_transform(sn, lambda y: {norm('y')}), {norm('x')})) AS missing FROM base),
sent AS (SELECT o, speakers, unnest(sents) AS s, generate_subscripts(sents, 1) AS i FROM base),
unit AS (SELECT o, i, list_distinct(list_transform(list_filter({words('s')}, lambda w: NOT list_contains({IGNORED}, w) AND length(w) > 2), lambda w: lower(w))) AS w,
        list_sort(list_transform(list_filter(speakers, lambda p: strpos(lower(s), lower(p)) > 0), lambda p: struct_pack(at := strpos(lower(s), lower(p)), p := p)))[1].p AS who FROM sent),
alike AS (SELECT a.o, a.i, b.i AS j, a.who AS a, b.who AS b, CASE WHEN len(list_distinct(a.w || b.w)) = 0 THEN 0.0::DOUBLE
        ELSE len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(a.w || b.w))::DOUBLE END AS sim FROM unit a JOIN unit b ON a.o = b.o AND a.i < b.i),
pair_flags AS (SELECT o, bool_or(sim >= 0.82) AS dup, bool_or(sim >= 0.68 AND a IS NOT NULL AND b IS NOT NULL AND a <> b) AS conf FROM alike GROUP BY o),
flags AS (SELECT base.o, len(people.bad) > 0 AS unsupported_person, len(support.extra) > 0 AS unsupported_number, len(support.missing) > 0 AS possible_number_omission,
        coalesce(dup, false) AS duplicate_event, coalesce(conf, false) AS possible_attribution_conflict,
        NOT regexp_matches({strip('summary')}, '[.!?]["'')\\]]?$') AND {strip('summary')} <> '' AS incomplete_sentence, false AS input_truncated
      FROM base JOIN people ON base.o = people.o JOIN support ON base.o = support.o LEFT JOIN pair_flags ON base.o = pair_flags.o),
risky AS (SELECT *, CASE WHEN unsupported_person OR unsupported_number OR possible_attribution_conflict OR incomplete_sentence THEN 'high'
        WHEN possible_number_omission OR duplicate_event THEN 'medium' ELSE 'low' END AS risk FROM flags)"""
MESSAGES = {code: message for code, _, message in L.REASONS}
REASON_ROWS = " UNION ALL ".join(f"SELECT o, '{c}' AS code, '{s}' AS severity FROM flags WHERE {c}" for c, s, _ in L.REASONS[1:])

PROMPT = 'Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.\n\n### Instruction:\n' + L.DIRECT_INSTRUCTION + "\n\n### Input:\n"
PROMPT_SQL, PROMPT_END = q(PROMPT), q("\n\n### Response:\n")
ROUGE = """k AS MATERIALIZED (SELECT count(*) AS n FROM benchmark),
b AS MATERIALIZED (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS r FROM benchmark),
d AS MATERIALIZED (SELECT doc_id, ((doc_id % n) + n) % n AS item, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS p FROM documents, k),
g AS MATERIALIZED (SELECT doc_id, len(r) AS nr, len(p) AS np, greatest(len(r) - 1, 0) AS nr2, greatest(len(p) - 1, 0) AS np2, r, p FROM d JOIN b ON item_id = item),
c1 AS (SELECT doc_id, sum(least(x.n, y.n)) AS n FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(r) AS w FROM g) GROUP BY ALL) x
       JOIN (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(p) AS w FROM g) GROUP BY ALL) y USING (doc_id, w) GROUP BY doc_id),
c2 AS (SELECT doc_id, sum(least(x.n, y.n)) AS n FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1])) AS w FROM g) GROUP BY ALL) x
       JOIN (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1])) AS w FROM g) GROUP BY ALL) y USING (doc_id, w) GROUP BY doc_id),
s AS (SELECT g.doc_id, CASE WHEN np > 0 THEN coalesce(c1.n, 0) / np::DOUBLE ELSE 0 END AS p1, CASE WHEN nr > 0 THEN coalesce(c1.n, 0) / nr::DOUBLE ELSE 0 END AS r1,
             CASE WHEN np2 > 0 THEN coalesce(c2.n, 0) / np2::DOUBLE ELSE 0 END AS p2, CASE WHEN nr2 > 0 THEN coalesce(c2.n, 0) / nr2::DOUBLE ELSE 0 END AS r2
      FROM g LEFT JOIN c1 ON g.doc_id = c1.doc_id LEFT JOIN c2 ON g.doc_id = c2.doc_id)"""
SCORED = """modes(mode, late) AS (VALUES ('direct', 0), ('hierarchical', 1)),
scored AS (SELECT o_orderkey AS source_index, CASE WHEN o_orderkey % 5 < 3 THEN 'real_long' ELSE 'synthetic_stress' END AS eval_type, mode, (2 + o_orderkey % 13 + late * (o_orderkey % 7 - 2)) / 24.0::DOUBLE AS rougeL,
            (1 + o_orderkey % 7 + late * (o_orderkey % 5 - 1)) / 16.0::DOUBLE AS rouge1_recall, (2 + o_orderkey % 4 - late * (o_orderkey % 3)) / 2.0::DOUBLE AS critical,
            1.0::DOUBLE AS coverage, 'x' AS summary, 2.0::DOUBLE AS memory FROM orders, modes),
paired AS (SELECT a.source_index, a.eval_type, b.rougeL - a.rougeL AS dl, b.rouge1_recall - a.rouge1_recall AS dr, b.critical - a.critical AS dc, a.critical AS base
           FROM scored a JOIN scored b ON a.source_index = b.source_index AND a.mode = 'direct' AND b.mode = 'hierarchical')"""


#: Non-blank lines of each dialogue, with their tokens.
TURNS = f"""{DIALOGUES}, s AS (SELECT conv_id, string_split(dialogue, chr(10)) AS l FROM dialogues),
        r AS (SELECT conv_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS idx FROM s),
        t AS (SELECT conv_id, idx, {strip('line')} AS line, len({tokens('line')}) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY idx) AS pos FROM r WHERE {strip('line')} <> '')"""


def greedy(name: str, parts: str, keys: str, budget: int) -> str:
    """name(keys, pos, k, total): the run k that greedy packing puts each of the parts (keys, pos from 1, n) into."""
    joined = " AND ".join(f"x.{k} = {name}.{k}" for k in keys.split(", "))
    full = f"{name}.total + x.n > {budget}"
    listed_keys = ", ".join(f"x.{k}" for k in keys.split(", "))
    return f"""{name} AS (SELECT {keys}, pos, 0::BIGINT AS k, n::BIGINT AS total FROM {parts} WHERE pos = 1
              UNION ALL SELECT {listed_keys}, x.pos, CASE WHEN {full} THEN {name}.k + 1 ELSE {name}.k END, CASE WHEN {full} THEN x.n ELSE {name}.total + x.n END
              FROM {name} JOIN {parts} x ON {joined} AND x.pos = {name}.pos + 1)"""


#: The packing's parts under a budget of 100: turns, and of longer turns runs of sentences, the longest as windows.
PARTS = f"""{TURNS},
        sent AS (SELECT conv_id, idx, unnest({sentences('line')}) AS s, generate_subscripts({sentences('line')}, 1) AS ord FROM t WHERE n > 100),
        win AS (SELECT conv_id, idx, ord, m, unnest(range(0, greatest(0, ceil((m - 100) / 80.0))::BIGINT + 1)) AS j FROM (SELECT conv_id, idx, ord, len({tokens('s')}) AS m FROM sent)),
        cut AS (SELECT conv_id, idx, row_number() OVER (PARTITION BY conv_id, idx ORDER BY ord, j) AS pos, least(100, m - 80 * j) AS n FROM win),
        {greedy('inner_run', 'cut', 'conv_id, idx', 100)},
        part AS (SELECT conv_id, idx, row_number() OVER (PARTITION BY conv_id ORDER BY idx, k) AS pos, n FROM
                 (SELECT conv_id, idx, 0 AS k, n FROM t WHERE n <= 100 UNION ALL SELECT conv_id, idx, k, max(total) FROM inner_run GROUP BY conv_id, idx, k)),
        {greedy('run', 'part', 'conv_id', 100)}"""


def action(text: str, names: str) -> str:
    """Distinct action words of a text, without those among the names."""
    long = f"list_transform(list_filter({words(text)}, lambda w: length(w) > 2), lambda w: lower(w))"
    return f"list_distinct(list_filter({long}, lambda w: NOT list_contains({listed(L.ACTION_STOP)}, w) AND NOT list_contains({names}, w)))"


def who(text: str) -> str:
    """The speaker of ``sp`` that the text names first."""
    return f"list_sort(list_transform(list_filter(sp, lambda p: strpos(lower({text}), lower(p)) > 0), lambda p: struct_pack(at := strpos(lower({text}), lower(p)), p := p)))[1].p"


#: Repair, rule by rule, per order: evidence (ev), sentences (u0) with who is claimed to do what, those after
#: reassigning (u2), pairs in order (pr), and the sentences that go, pair by pair (st).
REPAIR = f"""WITH RECURSIVE {PAIRS},
b AS (SELECT o, dialogue, summary, {SPEAKERS} AS sp FROM pairs),
nm AS (SELECT o, unnest(sp) AS p, list_transform(sp, lambda x: lower(x)) AS low FROM b),
ln AS (SELECT o, lower(trim(regexp_extract(line, '^\\s*([^:]{{1,40}}):\\s*(.+)$', 1))) AS owner, regexp_extract(line, '^\\s*([^:]{{1,40}}):\\s*(.+)$', 2) AS utt
       FROM (SELECT o, unnest(string_split(dialogue, chr(10))) AS line FROM b)),
ev AS (SELECT nm.o, p, {action('utt', 'low')} AS acts, list_transform({words('utt')}, lambda w: lower(w)) AS said FROM nm JOIN ln ON nm.o = ln.o
       WHERE utt <> '' AND (owner = lower(p) OR regexp_matches(utt, '(?i)^\\s*' || p || '(?:,|\\s+(?:will|must|should|needs? to|please))'))),
u0 AS (SELECT o, sp, list_transform(sp, lambda x: lower(x)) AS low, unnest(regexp_extract_all({strip('summary')}, '[^.!?]+[.!?]')) AS s, generate_subscripts(regexp_extract_all({strip('summary')}, '[^.!?]+[.!?]'), 1) AS i FROM b),
u1 AS (SELECT o, sp, low, i, trim(s) AS s, {who('s')} AS who, {action('s', 'low')} AS w FROM u0),
cl AS (SELECT *, CASE WHEN who IS NOT NULL THEN lower(regexp_extract(s, '(?i)^' || who || '\\s+(?:will|must|should|can|could|plans? to|needs? to|is going to)\\s+([A-Za-z''-]+)', 1)) ELSE '' END AS verb FROM u1),
bs AS (SELECT cl.o, cl.i, max(struct_pack(s := len(list_intersect(cl.w, ev.acts))::DOUBLE / greatest(1, len(cl.w)), p := ev.p)) AS best
       FROM cl JOIN ev ON cl.o = ev.o AND ev.p <> cl.who
       WHERE cl.verb <> '' AND EXISTS (SELECT 1 FROM ev e WHERE e.o = cl.o AND e.p = ev.p AND list_contains(e.said, cl.verb)) GROUP BY cl.o, cl.i),
sd AS (SELECT DISTINCT cl.o, cl.i FROM cl JOIN ev ON cl.o = ev.o AND ev.p = cl.who AND list_contains(ev.said, cl.verb)),
u2 AS (SELECT cl.o, cl.sp, cl.low, cl.i, coalesce(cl.verb <> '' AND sd.i IS NULL AND bs.best.s >= {L.BEST_SUPPORT}, false) AS wrong,
              CASE WHEN coalesce(cl.verb <> '' AND sd.i IS NULL AND bs.best.s >= {L.BEST_SUPPORT}, false) THEN bs.best.p || cl.s[length(cl.who) + 1:] ELSE cl.s END AS s
       FROM cl LEFT JOIN bs ON cl.o = bs.o AND cl.i = bs.i LEFT JOIN sd ON cl.o = sd.o AND cl.i = sd.i),
u3 AS (SELECT o, i, s, wrong, {who('s')} AS who, {action('s', 'low')} AS w FROM u2),
u4 AS (SELECT u3.o, u3.i, any_value(s) AS s, any_value(wrong) AS wrong, any_value(who) AS who, any_value(w) AS w, coalesce(max(len(list_intersect(w, ev.acts))::DOUBLE / greatest(1, len(w))), 0) AS support
       FROM u3 LEFT JOIN ev ON u3.o = ev.o AND u3.who = ev.p GROUP BY u3.o, u3.i),
pr0 AS (SELECT a.o, a.i, b.i AS j, a.who = b.who AS same, len(a.w) <= len(b.w) AS less, a.support AS si, b.support AS sj,
               len(list_intersect(a.w, b.w))::DOUBLE / greatest(1, len(list_distinct(a.w || b.w))) AS sim FROM u4 a JOIN u4 b ON a.o = b.o AND a.i < b.i AND a.who IS NOT NULL AND b.who IS NOT NULL),
pr1 AS (SELECT *, same AND sim >= {L.SAME_SPEAKER} AS rep, NOT same AND sim >= {L.CONFLICT} AS opp FROM pr0),
pr2 AS (SELECT *, (rep AND less) OR (opp AND si <= {L.WEAK} AND sj >= {L.STRONG}) AS fst, rep OR (opp AND sj <= {L.WEAK} AND si >= {L.STRONG}) AS snd FROM pr1),
pr AS MATERIALIZED (SELECT o, CASE WHEN fst THEN i ELSE j END AS d, CASE WHEN fst THEN j ELSE i END AS kp, CASE WHEN rep THEN '{L.REPEATED_EVENT}' ELSE '{L.OPPOSED_EVENT}' END AS reason,
              row_number() OVER (PARTITION BY o ORDER BY i, j) AS n FROM pr2 WHERE fst OR snd),
st AS (SELECT DISTINCT o, 0::BIGINT AS n, []::BIGINT[] AS gone, []::VARCHAR[] AS log FROM b
       UNION ALL SELECT st.o, pr.n, CASE WHEN list_contains(st.gone, pr.d) OR list_contains(st.gone, pr.kp) THEN st.gone ELSE list_append(st.gone, pr.d) END,
              CASE WHEN list_contains(st.gone, pr.d) OR list_contains(st.gone, pr.kp) THEN st.log ELSE list_append(st.log, pr.reason || ':' || pr.d || '>' || pr.kp) END
       FROM st JOIN pr ON st.o = pr.o AND pr.n = st.n + 1),
fin AS (SELECT o, arg_max(gone, n) AS gone, arg_max(log, n) AS log FROM st GROUP BY o),
res AS (SELECT fin.o, coalesce(string_agg(u4.s, ' ' ORDER BY u4.i) FILTER (WHERE NOT list_contains(gone, u4.i)), '') AS joined,
               coalesce(list('{L.WRONG_ACTOR}:' || u4.i ORDER BY u4.i) FILTER (WHERE wrong), []::VARCHAR[]) || any_value(log) AS log FROM fin LEFT JOIN u4 ON fin.o = u4.o GROUP BY fin.o)"""


ORACLE_SQL: dict[str, str] = {
    "dialogue_assembly": f"WITH {DIALOGUES} SELECT conv_id, dialogue FROM dialogues",
    "dialogue_lines": f"""WITH {DIALOGUES}, l AS (SELECT conv_id, unnest(string_split_regex(dialogue, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e]')) AS line,
        generate_subscripts(string_split_regex(dialogue, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e]'), 1) - 1 AS idx FROM dialogues)
        SELECT conv_id, idx, {strip('line')} AS line FROM l WHERE {strip('line')} <> ''""",
    "speaker_facts": f"WITH {DIALOGUES} SELECT conv_id, unnest(list_distinct(list_transform(regexp_extract_all(dialogue, '(?m)^\\s*([A-Z][A-Za-z .''-]{{0,39}}?):', 1), lambda x: {strip('x')}))) AS speaker FROM dialogues",
    "dialogue_facts_text": f"""WITH {PAIRS}, f AS (SELECT o, {SPEAKERS} AS sp, {ordered(number_list('dialogue'))} AS nu,
        list_filter({ordered(cap_list('dialogue'))}, lambda w: NOT list_contains({listed(L.IGNORED_IN_FACTS)}, w)) AS caps FROM pairs)
        SELECT o, 'Dialogue speakers: ' || array_to_string(sp, ', ') || chr(10) || 'Mentioned people: ' || coalesce(nullif(array_to_string(list_filter(caps, lambda w: NOT list_contains(sp, w)), ', '), ''), 'none detected')
        || chr(10) || 'Numbers/times/amounts from source: ' || array_to_string(nu, ', ') AS facts FROM f""",
    "number_facts": f"WITH {DOCS} SELECT doc_id, unnest(list_distinct(list_transform({number_list('text')}, lambda x: {norm('x')}))) AS number FROM docs",
    "number_norm_counts": f"WITH {DOCS}, n AS (SELECT doc_id, unnest(list_distinct(list_transform({number_list('text')}, lambda x: {norm('x')}))) AS number FROM docs) SELECT number, count(*) AS n_docs FROM n GROUP BY number",
    "mentioned_people": f"WITH {DOCS}, c AS (SELECT doc_id, list_distinct({cap_list('text')}) AS caps FROM docs) SELECT doc_id, unnest(list_filter(caps, lambda w: NOT list_contains({listed(L.IGNORED_IN_FACTS)}, w))) AS person FROM c",
    "sentence_split_a": f"WITH {DOCS} SELECT doc_id, unnest({sentences('text')}) AS sentence, generate_subscripts({sentences('text')}, 1) - 1 AS pos FROM docs",
    "sentence_units_b": f"""WITH {DOCS}, u AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all({strip('text')}, '[^.!?]+[.!?]'), lambda x: {strip('x')}), lambda x: x <> '') AS s FROM docs)
        SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM u""",
    "complete_sentences_c": f"WITH {DOCS} SELECT doc_id, array_to_string(list_transform(regexp_extract_all({strip('text')}, '.+?[.!?](?:[\"'')\\]]?)(?:\\s+|$)'), lambda x: {strip('x')}), ' ') AS complete FROM docs",
    "incomplete_flag": f"WITH {DOCS} SELECT doc_id, {strip('text')} <> '' AND NOT regexp_matches({strip('text')}, '[.!?][\"'')\\]]?$') AS incomplete FROM docs",
    "content_words": f"""WITH {DOCS}, w AS (SELECT doc_id, list_sort(list_distinct(list_transform(list_filter({words('text')}, lambda w: NOT list_contains({IGNORED}, w) AND length(w) > 2), lambda w: lower(w)))) AS w FROM docs)
        SELECT doc_id, len(w) AS n_words, array_to_string(w, ' ') AS words FROM w""",
    "action_words": f"""WITH {PAIRS}, f AS (SELECT o, list_transform({SPEAKERS}, lambda x: lower(x)) AS sp, list_transform(list_filter({words('summary')}, lambda w: length(w) > 2), lambda w: lower(w)) AS w FROM pairs),
        k AS (SELECT o, list_sort(list_distinct(list_filter(w, lambda x: NOT list_contains({listed(L.ACTION_STOP)}, x) AND NOT list_contains(sp, x)))) AS w FROM f)
        SELECT o, len(w) AS n_words, array_to_string(w, ' ') AS words FROM k""",
    "primary_speaker": f"WITH {CHECKED} SELECT o, i - 1 AS pos, who AS speaker FROM unit",
    "route_mode": f"WITH {DIALOGUES}, t AS (SELECT conv_id, len({tokens(f'{PROMPT_SQL} || {strip("dialogue")} || {PROMPT_END}')}) AS n FROM dialogues) SELECT conv_id, n AS prompt_tokens, CASE WHEN n <= {L.PROMPT_TOKENS} THEN 'direct' ELSE 'hierarchical' END AS mode FROM t",
    "long_filter": f"WITH {DOCS}, t AS (SELECT doc_id, len({tokens('text')}) AS n FROM docs) SELECT doc_id, n AS input_tokens, 'real_long' AS eval_type FROM t WHERE n > {L.LONG_TOKENS}",
    "collapse_repeated": f"""WITH {DIALOGUES}, r AS (SELECT conv_id, array_to_string(list_transform(range(0, conv_id % 3 + 1), lambda i: dialogue), chr(10)) AS dialogue FROM dialogues),
        l AS (SELECT conv_id, dialogue, list_filter(list_transform(string_split(dialogue, chr(10)), lambda x: {strip('x')}), lambda x: x <> '') AS l FROM r),
        k AS (SELECT conv_id, min(k) AS k FROM (SELECT conv_id, l, unnest(range(4, len(l) // 2 + 1)) AS k FROM l) WHERE len(l) % k = 0 AND len(list_filter(l, lambda x, i: x <> l[(i - 1) % k + 1])) = 0 GROUP BY conv_id)
        SELECT l.conv_id, CASE WHEN k IS NULL THEN {strip('dialogue')} ELSE array_to_string(l[1:k], chr(10)) END AS block, CASE WHEN k IS NULL THEN 0 ELSE len(l) - k END AS deduplicated_turns
        FROM l LEFT JOIN k ON l.conv_id = k.conv_id""",
    "token_windows": f"""WITH {DOCS}, t AS (SELECT doc_id, {tokens('text')} AS t FROM docs), w AS (SELECT doc_id, t, unnest(range(0, (greatest(0, ceil((len(t) - 100) / 80.0)::INT) + 1)::BIGINT)) AS k FROM t)
        SELECT doc_id, k, array_to_string(t[k * 80 + 1 : k * 80 + 100], ' ') AS part FROM w""",
    "chunk_pack": f"""WITH RECURSIVE {TURNS}, {greedy('f', 't', 'conv_id', L.CHUNK_TOKENS)}
        SELECT t.conv_id, f.k, sum(t.n)::BIGINT AS token_count, string_agg(t.idx::VARCHAR, ',' ORDER BY t.pos) AS turn_indices, string_agg(t.line, chr(10) ORDER BY t.pos) AS chunk
        FROM t JOIN f ON t.conv_id = f.conv_id AND t.pos = f.pos GROUP BY t.conv_id, f.k""",
    "chunk_coverage": f"""WITH RECURSIVE {PARTS},
        c AS (SELECT conv_id, max(total) AS most FROM run GROUP BY conv_id),
        w AS (SELECT t.conv_id, count(DISTINCT t.idx) AS turns, count(DISTINCT p.idx) AS seen FROM t LEFT JOIN (SELECT part.* FROM part JOIN run ON part.conv_id = run.conv_id AND part.pos = run.pos) p
              ON t.conv_id = p.conv_id AND t.idx = p.idx GROUP BY t.conv_id)
        SELECT w.conv_id, w.seen AS n_turns, c.most <= 100 AS within_budget, w.seen = w.turns AS covered FROM w JOIN c ON w.conv_id = c.conv_id""",
    "direct_truncate": f"""WITH RECURSIVE {DOCS}, c AS (SELECT doc_id, {strip('text')} AS t, length({strip('text')}) AS n, len({tokens(f'{PROMPT_SQL} || {strip("text")} || {PROMPT_END}')}) <= {L.PROMPT_TOKENS} AS fits FROM docs),
        l AS (SELECT doc_id, greatest(200, floor(n * 0.8::DOUBLE)::INT) AS k, 1 AS step FROM c WHERE NOT fits UNION ALL SELECT doc_id, floor(k * 0.8::DOUBLE)::INT, step + 1 FROM l WHERE k > 200),
        p AS (SELECT l.doc_id, k, step, n, {PROMPT_SQL} || left(t, floor(k * 0.7::DOUBLE)::INT) || {q(L.TRUNCATION_MARK)} || right(t, k - floor(k * 0.7::DOUBLE)::INT) || {PROMPT_END} AS prompt FROM l JOIN c ON l.doc_id = c.doc_id WHERE k > 200),
        b AS (SELECT doc_id, arg_min(k, step) AS k, arg_min(length(prompt), step) AS chars FROM p WHERE len({tokens('prompt')}) <= {L.PROMPT_TOKENS} GROUP BY doc_id)
        SELECT c.doc_id, CASE WHEN fits THEN false WHEN k IS NOT NULL THEN true END AS truncated, round(CASE WHEN fits THEN 1.0::DOUBLE ELSE least(1.0, k / n::DOUBLE) END, 9) AS coverage,
        CASE WHEN fits THEN n + {len(PROMPT) + len(chr(10) * 2 + '### Response:' + chr(10))} ELSE chars END AS prompt_chars FROM c LEFT JOIN b ON c.doc_id = b.doc_id""",
    "reliability_flags": f"WITH {CHECKED} SELECT o, risk, unsupported_person, unsupported_number, possible_number_omission, duplicate_event, possible_attribution_conflict, incomplete_sentence, input_truncated FROM risky",
    "reliability_reasons": f"WITH {CHECKED} {REASON_ROWS}",
    "risk_histogram": f"WITH {CHECKED} SELECT risk, count(*) AS n FROM risky GROUP BY risk",
    "reason_display": f"""WITH {CHECKED} SELECT o, 'Check these figures: ' || array_to_string({ordered('extra')}, '、') AS line FROM support WHERE len(extra) > 0
        UNION ALL SELECT o, {q(MESSAGES['unsupported_person'] + ' ')} || array_to_string({ordered('bad')}, '、') FROM people WHERE len(bad) > 0
        UNION ALL SELECT o, {q(MESSAGES['possible_number_omission'] + ' ')} || array_to_string({ordered('missing')}, '、') FROM support WHERE len(missing) > 0
        UNION ALL """ + " UNION ALL ".join(f"SELECT o, {q(MESSAGES[c])} FROM flags WHERE {c}" for c in ("duplicate_event", "possible_attribution_conflict", "incomplete_sentence", "input_truncated")),
    "number_support": f"""WITH {CHECKED} SELECT o, 'unsupported' AS kind, unnest(list_distinct(extra)) AS value FROM support UNION ALL SELECT o, 'omitted', unnest(list_distinct(missing)) FROM support""",
    "duplicate_pairs": f"WITH {CHECKED} SELECT o, i, j FROM alike WHERE sim >= 0.82",
    "attribution_conflicts": f"WITH {CHECKED} SELECT o, i, j, a, b FROM alike WHERE sim >= 0.68 AND a IS NOT NULL AND b IS NOT NULL AND a <> b",
    "repair_log": f"{REPAIR} SELECT res.o, CASE WHEN joined = '' THEN {strip('summary')} ELSE joined END AS repaired, array_to_string(log, ';') AS log FROM res JOIN b ON res.o = b.o",
    "attribution_repair": f"{REPAIR} SELECT split_part(r, ':', 1) AS reason, count(*) AS n, count(DISTINCT o) AS n_orders FROM (SELECT o, unnest(log) AS r FROM res) GROUP BY 1",
    "rouge_1_2": f"""WITH {ROUGE} SELECT doc_id, round(p1, 9) AS rouge1_precision, round(r1, 9) AS rouge1_recall, round(CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0 END, 9) AS rouge1_fmeasure,
        round(p2, 9) AS rouge2_precision, round(r2, 9) AS rouge2_recall, round(CASE WHEN p2 + r2 > 0 THEN 2 * p2 * r2 / (p2 + r2) ELSE 0 END, 9) AS rouge2_fmeasure FROM s""",
    "error_proxies": f"""WITH {CHECKED}, e AS (SELECT o, (len(list_filter(speakers, lambda p: strpos(lower(summary), lower(p)) = 0)) > 0)::INT AS speaker,
        (len(list_filter(dn, lambda x: NOT list_contains(sn, x))) + len(list_filter(sn, lambda x: NOT list_contains(dn, x))) > 0)::INT AS number FROM base) SELECT o, speaker, number, (speaker + number)::DOUBLE AS critical FROM e""",
    "mode_means": f"WITH {SCORED} SELECT mode, count(*) AS n, round(avg(rougeL), 9) AS rougeL, round(avg(rouge1_recall), 9) AS rouge1_recall, round(avg(critical), 9) AS critical FROM scored GROUP BY mode",
    "paired_delta_report": f"""WITH {SCORED} SELECT eval_type, count(*) AS n, round(avg(dl), 9) AS rougeL_delta, round(avg(dr), 9) AS rouge1_recall_delta, round(avg(dc), 9) AS critical_delta,
        round(avg(dc) / avg(base), 9) AS critical_relative_change FROM paired GROUP BY eval_type""",
    "gates": f"""WITH {SCORED},
        faulty AS (SELECT 'none' AS fault, * FROM scored
            UNION ALL SELECT 'coverage', * REPLACE (CASE WHEN mode = 'hierarchical' AND source_index % 9 = 0 THEN 0.75 ELSE coverage END AS coverage) FROM scored
            UNION ALL SELECT 'summary', * REPLACE (CASE WHEN mode = 'hierarchical' AND source_index % 9 = 0 THEN '' ELSE summary END AS summary) FROM scored
            UNION ALL SELECT 'memory', * REPLACE (CASE WHEN source_index % 9 = 0 THEN 6.0 ELSE memory END AS memory) FROM scored
            UNION ALL SELECT 'unmeasured', * REPLACE (CASE WHEN source_index % 9 > 0 THEN memory END AS memory) FROM scored
            UNION ALL SELECT 'direct rows', * REPLACE (CASE WHEN mode = 'hierarchical' THEN summary ELSE '' END AS summary) FROM scored
            UNION ALL SELECT 'no gain', * REPLACE ((source_index % 7) / 16.0::DOUBLE AS rouge1_recall, (source_index % 4 + 1)::DOUBLE AS critical) FROM scored
            UNION ALL SELECT 'worse', * REPLACE (CASE WHEN mode = 'hierarchical' THEN 0.0 ELSE rougeL END AS rougeL) FROM scored),
        ok AS (SELECT fault, count(*) FILTER (WHERE coverage <> 1 OR summary = '' OR memory IS NULL OR memory > 5.5) = 0 AS rows_ok FROM faulty WHERE mode = 'hierarchical' GROUP BY fault),
        d AS (SELECT a.fault, avg(b.rougeL - a.rougeL) AS dl, avg(b.rouge1_recall - a.rouge1_recall) AS dr, avg(b.critical - a.critical) / avg(a.critical) AS dc
              FROM faulty a JOIN faulty b ON a.fault = b.fault AND a.source_index = b.source_index AND a.mode = 'direct' AND b.mode = 'hierarchical' GROUP BY a.fault)
        SELECT d.fault, rows_ok AND dl >= -0.01 AS engineering_gate_passed, rows_ok AND dl >= -0.01 AND (dr >= 0.03 OR dc <= -0.05) AS quality_gate_passed FROM d JOIN ok ON d.fault = ok.fault""",
    "group_counts": f"WITH {SCORED} SELECT eval_type, count(*) AS n, max(base) AS most, min(base) AS least FROM paired GROUP BY eval_type",
    "mode_extremes": """SELECT mode, count(*) AS n, min(1 - (o_orderkey % 3) / 16.0::DOUBLE) AS least_coverage, min(400 + o_orderkey % 97) AS least_tokens,
        max(CASE WHEN mode = 'direct' THEN 1 + (o_orderkey % 8) / 4.0::DOUBLE END) AS peak_memory_gb FROM orders, (VALUES ('direct'), ('hierarchical')) m(mode) GROUP BY mode""",
    "topk_longest": f"WITH {DOCS} SELECT doc_id, len({tokens('text')}) AS input_tokens FROM docs ORDER BY 2 DESC, 1 LIMIT 15",
    "resume_anti_join": "SELECT doc_id AS source_index FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
}
