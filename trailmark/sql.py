"""The SQL of the queries, for an engine with RE2 patterns and list functions."""

from __future__ import annotations

import re

from trailmark.functions import tools as _T
from trailmark.functions.text import EXECUTION, PREPARATION, REASONING
from trailmark.operators.embed import CONCEPTS

WS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: A word character, and the edges of a word.
WORD = r"[\p{L}\p{M}\p{N}_]"
L, R = r"(?:^|[^\p{L}\p{M}\p{N}_])", r"(?:$|[^\p{L}\p{M}\p{N}_])"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def fold(x: str) -> str:
    return strip(f"regexp_replace(replace(lower({x}), 'ß', 'ss'), '{WS}+', ' ', 'g')")


SAMPLES = """samples as (
  select * from demo_samples qualify row_number() over (partition by id order by ingested_at desc nulls last) = 1
)"""
STEPS = f"""{SAMPLES}, stepped as (
  select *, list_filter(list_transform(list_filter(coalesce(reference_steps, []), lambda s: s is not null),
      lambda s: list_filter(list_transform(list_filter(s, lambda c: c is not null), lambda c: {strip("c")}), lambda c: c <> '')), lambda s: len(s) > 0) as steps
  from samples
)"""


def label(s: str) -> str:
    return f"array_to_string({s}, ' | ')"


def numbered(name: str, source: str, list_: str, item: str) -> str:
    """A CTE with the items of a list and their positions from 0."""
    return f"{name} as (select *, unnest({list_}) as {item}, generate_subscripts({list_}, 1) - 1 as pos from {source})"


def _end(s: str, window: int) -> str:
    """The end of the window that starts at ``s`` in text ``t`` of ``n`` characters."""
    sub = f"substr(t, {s} + 1, {window})"
    k = f"length(regexp_replace({sub}, '[^。，； \n]*$', ''))"
    return f"case when {s} + {window} >= n then n when {k} > 0 and {s} + {k} - 1 > {s} + {window // 2} then {s} + {k} else {s} + {window} end"


def windows(window: int, stride: int) -> str:
    return f"""{SAMPLES}, texts as (select id, {strip("coalesce(response, '')")} as t from samples),
  sized as (select id, t, length(t) as n from texts),
  wins as (
    select id, t, n, 0 as i, 0 as s, {_end("0", window)} as e from sized where n > 0
    union all
    select id, t, n, i, s, {_end("s", window)} from (select id, t, n, i + 1 as i, greatest(e - {stride}, s + 1) as s from wins where e < n)
  )"""


def _windows_as(prefix: str, window: int, stride: int) -> str:
    """:func:`windows` without its samples, under other names."""
    return re.sub(r"\b(texts|sized|wins)\b", rf"{prefix}\1", windows(window, stride)[len(SAMPLES) + 2 :])


def kept(cap: int) -> str:
    """The windows that remain of more than ``cap``."""
    return f"""counted as (select *, count(*) over (partition by id) as m from wins),
  capped as (select * from counted where m <= {cap} or list_contains(list_transform(range(0, {cap}), lambda k: cast(round_even(k * (m - 1) / {cap - 1}, 0) as bigint)), i))"""


def mask(x: str) -> str:
    bits = [f"(case when {' or '.join(f'contains(lower({x}), {chr(39)}{s}{chr(39)})' for s in sp)} then {1 << k} else 0 end)" for k, sp in enumerate(CONCEPTS.values())]
    return "(" + " + ".join(bits) + ")"


def cosine(a: str, b: str) -> str:
    return f"(case when {a} = 0 or {b} = 0 then 0.0 else bit_count({a} & {b}) / sqrt(bit_count({a}) * bit_count({b})) end)"


SIMS = f"""{windows(48, 24)}, {kept(256)},
  placed as (select id, row_number() over (partition by id order by i) - 1 as win, {mask("substr(t, s + 1, e - s)")} as wm from capped),
  {STEPS.replace(SAMPLES + ", ", "")}, {numbered("steps1", "(select id, steps from stepped)", "steps", "step")},
  cands as (select id, pos as step, unnest(step) as c from steps1),
  masked as (select distinct id, step, {mask("c")} as cm from cands),
  sims as (select m.id, m.step, p.win, max({cosine("cm", "wm")}) as sim from masked m join placed p on p.id = m.id group by all)"""
BEST = f"""{SIMS},
  ranked as (select *, row_number() over (partition by id, step order by sim desc, win) as r from sims),
  best as (select a.id, a.step, a.win, a.sim, coalesce(b.sim, 0.0) as second from ranked a left join ranked b on a.id = b.id and a.step = b.step and b.r = 2 where a.r = 1)"""

#: All texts that an encoder is asked for, by role.
SAID = f"""{STEPS}, {_windows_as("c_", 128, 64)}, {_windows_as("f_", 48, 24)},
  said as (select 'query' as role, unnest(flatten(steps)) as text from stepped union all select 'passage', substr(t, s + 1, e - s) from c_wins union all select 'passage', substr(t, s + 1, e - s) from f_wins)"""

TOOL_TRACE = (
    rf"(?im)<{WORD}+>|^diff --git|^@@ |^--- a/|^\+\+\+ b/|```|{L}def {WORD}|{WORD}\([^)]*\)|{L}(?:src|tests?)/[^\s]|{L}{WORD}+\.py{R}|Output:"
    rf"|{L}passed{R}|{L}fail(?:ed|ure)?{R}"
)
REASONING_TRACE = (
    rf"(?i){L}(?:root cause\s+(?:is|was|are|were)|the (?:issue|problem|bug)\s+(?:is|was|lies)|because|due to|caused by|therefore|thus|hence|leads? to|results? (?:in|from)){R}"
)
HAS_TRACE = f"""case when coalesce(response, '') = '' then false
  when regexp_matches(response, '{TOOL_TRACE}') then true
  else regexp_matches(list_reduce(flatten(steps), lambda t, s: regexp_replace(t, regexp_escape(s), ' ', 'gi'), response), '{REASONING_TRACE}') end"""
INTENTION = (
    rf"(?i){L}(?:i|we)?\s*(?:will|would|plan(?:ning)?\s+to|intend(?:ing)?\s+to|(?:am|are)\s+going\s+to|need\s+to){R}|(?:将|会|计划|打算|准备|需要)"
)
_SENTENCES = (
    f"list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(response, ''), '([.!?。！？；;])', '\\1\n', 'g'), '\n+'), lambda x: {strip('x')}), lambda x: x <> '')"
)
_MENTION = "list_bool_or(list_transform(step, lambda c: contains(lower(x), lower(c))))"
TOLD = f"""sentenced as (select id, steps, {_SENTENCES} as sents from stepped),
  {numbered("tsteps", "sentenced", "steps", "step")},
  told1 as (select id, pos,
      coalesce(list_bool_or(list_transform(sents, lambda x: regexp_matches(x, '{INTENTION}') and {_MENTION})), false) as meant,
      coalesce(list_bool_or(list_transform(sents, lambda x: not regexp_matches(x, '{INTENTION}') and {_MENTION})), false) as done from tsteps),
  told as (select id, avg(case when meant and not done then 1.0 else 0.0 end) as fraction from told1 group by id)"""


def tier(x: str) -> str:
    return (
        f"case when {strip(x)} = '' then 'proxy' when regexp_matches({strip(x)}, '(?i){'|'.join(EXECUTION).replace(chr(92) + 'w', WORD)}') then 'observable' "
        f"when regexp_matches({strip(x)}, '(?i){'|'.join(REASONING)}') then 'reasoning' when regexp_matches({strip(x)}, '(?i){'|'.join(PREPARATION).replace(chr(92) + 'b', R)}') then 'proxy' else 'reasoning' end"
    )


def tiers(step: str) -> str:
    t = f"list_transform({step}, lambda c: {tier('c')})"
    return (
        f"case when list_contains({t}, 'observable') then 'observable' when len({step}) > 0 and len(list_filter({t}, lambda t: t <> 'proxy')) = 0 then 'proxy' else 'reasoning' end"
    )


_HIT = f"list_filter(steps, lambda s: contains(coalesce(response, ''), {label('s')}))"
_FOLDED = (
    f"case when len(steps) = 0 then 0.0 else len(list_filter(steps, lambda s: coalesce(list_bool_or(list_transform(s, lambda c: {fold('c')} <> '' and contains(ft, {fold('c')}))), false))) / len(steps) end"
)
ROUTED = f"""with {STEPS}, {TOLD},
  lex as (select s.*, case when len(steps) = 0 then 0.0 else len({_HIT}) / len(steps) end as rate, len(steps) - len({_HIT}) as missing,
      len(list_filter(steps, lambda s: ({tiers("s")}) = 'proxy')) / greatest(len(steps), 1) as proxy, coalesce(t.fraction, 0.0) as told,
      case when coalesce(response, '') <> '' then {HAS_TRACE} end as traced
    from stepped s left join told t on t.id is not distinct from s.id),
  conf as (select *, greatest(0.0, least(1.0, 0.35 * rate + 0.20 * rate + 0.10 * (1.0 - proxy)
      + case when traced then 0.08 when not traced and rate >= 0.8 then -0.15 else 0.0 end - 0.25 * told)) as confidence from lex),
  routed as (select *, list_filter([
      case when rate < 0.5 then format('low_match_rate ({{:.2f}} < 0.5)', rate) end,
      case when rate < 0.25 then format('low_order_rate ({{:.2f}} < 0.25)', rate) end,
      case when missing > 1 then 'too_many_unmatched (' || missing || ' > 1)' end,
      case when proxy >= 0.6 then format('high_proxy_step_fraction ({{:.2f}})', proxy) end,
      case when told >= 0.5 then format('intention_step_recitation ({{:.2f}} >= 0.50)', told) end,
      case when rate >= 0.95 and not traced then 'high_match_without_execution_trace' end,
      case when confidence < 0.5 then format('low_confidence ({{:.2f}} < 0.5)', confidence) end], lambda x: x is not null) as reasons from conf)"""
LABELLED = f"""{ROUTED}, folded as (select *, {fold("coalesce(response, '')")} as ft from routed),
  labelled as (select id, label, subtype, pair_id, confidence, len(reasons) > 0 as fallback, {_FOLDED} as score from folded),
  scored as (select *, case when fallback then 0.0 else score end as trusted_score from labelled)"""

# ------------------------------------------------------------------ alignment


def aligned(p: str, window: int, stride: int, threshold: float) -> str:
    """CTEs ``{p}fit``: the result of one pass of windows over ``inp`` (id, response, steps); single precision as the table has it."""
    wins = re.sub(r"\b(texts|sized|wins)\b", rf"{p}\1", windows(window, stride)[len(SAMPLES) + 2 :]).replace("from samples", "from inp")
    caps = re.sub(r"\b(counted|capped|wins)\b", rf"{p}\1", kept(256))
    t = f"cast({threshold} as float)"
    return f"""{wins}, {caps},
  {p}placed as (select id, row_number() over (partition by id order by i) - 1 as win, {mask("substr(t, s + 1, e - s)")} as wm from {p}capped),
  {p}cands as (select c.id, c.step, c.k, c.c, w.win, cast({cosine("c.cm", "w.wm")} as float) as sim from asked c join {p}placed w on w.id = c.id),
  {p}sims as (select id, step, win, max(sim) as sim from {p}cands group by all),
  {p}grid as (select id, step, list(sim order by win) as s, list(case when sim >= {t} then sim else cast(0 as float) end order by win) as g from {p}sims group by id, step),
  {p}dp as (select id, cast(-1 as bigint) as step, list_transform(any_value(g), lambda x: cast(0 as float)) as d from {p}grid where step = 0 group by id
    union all
    select r.id, r.step, list_transform(range(1, len(r.g) + 1), lambda i: list_max(list_transform(range(1, i + 1), lambda j:
        greatest(q.d[j], case when r.g[j] > 0 then (case when j = 1 then cast(0 as float) else q.d[j - 1] end) + r.g[j] else cast(0 as float) end))))
    from {p}dp q join {p}grid r on r.id = q.id and r.step = q.step + 1),
  {p}cells as (select r.id, r.step, list_transform(range(1, len(r.g) + 1), lambda j: case
      when r.g[j] > 0 and (case when j = 1 then cast(0 as float) else u.d[j - 1] end) + r.g[j] >= (case when j = 1 then cast(0 as float) else c.d[j - 1] end)
        and (case when j = 1 then cast(0 as float) else u.d[j - 1] end) + r.g[j] >= u.d[j] then 1
      when (case when j = 1 then cast(0 as float) else c.d[j - 1] end) >= u.d[j] then 2 else 3 end) as mv
    from {p}grid r join {p}dp u on u.id = r.id and u.step = r.step - 1 join {p}dp c on c.id = r.id and c.step = r.step),
  {p}walk as (select id, max(step) as step, any_value(len(mv)) as j, cast(0 as bigint) as hit_step, cast(0 as bigint) as hit_win, false as hit from {p}cells group by id
    union all
    select w.id, case c.mv[w.j] when 2 then w.step else w.step - 1 end, case c.mv[w.j] when 3 then w.j else w.j - 1 end, w.step, w.j, c.mv[w.j] = 1
    from {p}walk w join {p}cells c on c.id = w.id and c.step = w.step where w.step >= 0 and w.j >= 1),
  {p}hits as (select w.id, w.hit_step as step, w.hit_win as j, g.s[w.hit_win] as sim,
      greatest(cast(g.s[w.hit_win] as double) - case when len(g.s) > 1 then greatest(list_max(list_concat(g.s[1 : w.hit_win - 1], g.s[w.hit_win + 1 :])), -1.0) else 0.0 end, 0.0) as margin
    from {p}walk w join {p}grid g on g.id = w.id and g.step = w.hit_step where w.hit),
  {p}named as (select h.id, h.step, arg_max(c.c, c.sim * 1000 - c.k) as c, first(c.c order by c.sim desc, c.k) as best from {p}hits h join {p}cands c on c.id = h.id and c.step = h.step and c.win = h.j - 1 group by h.id, h.step),
  {p}top as (select id, step, list_max(s) as m, list_position(s, list_max(s)) as at from {p}grid),
  {p}order as (select a.id, case when count(b.step) = 0 then 1.0 else avg(case when a.at < b.at then 1.0 when a.at = b.at then 0.5 else 0.0 end) filter (where b.step is not null) end as rate
    from {p}top a left join {p}top b on b.id = a.id and a.step < b.step and b.m >= {t} where a.m >= {t} group by a.id),
  {p}fit as (select n.id, n.steps, len(n.steps) as n_steps, coalesce(h.c, 0) as n_hits, case when len(n.steps) > 0 then coalesce(h.c, 0) / len(n.steps) else 0.0 end as match_rate,
      case when h.c is null and o.rate is null then 0.0 else coalesce(o.rate, 0.0) end as order_rate, coalesce(h.sim, 0.0) as mean_sim, coalesce(h.low, 0.0) as min_sim, coalesce(h.margin, 0.0) as mean_margin,
      coalesce(array_to_string(m.names, ' | '), '') as matched, coalesce(m.names, []) as names, list_filter(range(0, len(n.steps)), lambda i: not list_contains(coalesce(h.at, []), i)) as missing
    from inp n left join (select id, count(*) as c, avg(cast(sim as double)) as sim, min(cast(sim as double)) as low, avg(margin) as margin, list(step) as at from {p}hits group by id) h on h.id = n.id
    left join (select id, list(best order by step) as names from {p}named group by id) m on m.id = n.id left join {p}order o on o.id = n.id)"""


#: ``chosen``: the coarse pass, and the fine one where it misses a step and is not the worse.
BOTH = f"""asked as (select id, cast(pos as bigint) as step, k, c, {mask("c")} as cm from (select id, pos, unnest(step) as c, generate_subscripts(step, 1) as k from (select *, unnest(steps) as step, generate_subscripts(steps, 1) - 1 as pos from (select id, steps from inp)))),
  {aligned("c_", 128, 64, 0.45 * 0.9)}, {aligned("f_", 48, 24, 0.45)},
  chosen as (select case when c.match_rate >= 1.0 then 'coarse' else 'coarse_to_fine' end as method, unnest(case when c.match_rate >= 1.0 or f.match_rate < c.match_rate then c else f end) from c_fit c join f_fit f on f.id = c.id)"""
SCORED = f"""{STEPS}, inp as (select id, response, steps from stepped), {BOTH}"""

_RAW_TIERS = tiers("s").replace("lambda c: " + tier("c"), "lambda c: " + tier("coalesce(c, '')"))
#: ``judged``: confidence and reasons of ``base`` (id, response, steps, raw, match_rate, order_rate, mean_sim, mean_margin, n_missing).
JUDGED = f"""{TOLD.replace("stepped", "inp")},
  lex as (select s.*, len(list_filter(raw, lambda s: ({_RAW_TIERS}) = 'proxy')) / greatest(len(steps), 1) as proxy, coalesce(t.fraction, 0.0) as told,
      case when coalesce(response, '') <> '' then {HAS_TRACE} end as traced from base s left join told t on t.id is not distinct from s.id),
  conf as (select *, greatest(0.0, least(1.0, 0.35 * match_rate + 0.20 * order_rate + 0.25 * greatest(0.0, least(1.0, mean_sim)) + 0.10 * greatest(0.0, least(1.0, mean_margin / 0.05)) + 0.10 * (1.0 - proxy)
      + case when traced then 0.08 when not traced and match_rate >= 0.8 then -0.15 else 0.0 end - 0.25 * told)) as confidence from lex),
  judged as (select *, list_filter([
      case when match_rate < 0.5 then format('low_match_rate ({{:.2f}} < 0.5)', match_rate) end,
      case when order_rate < 0.25 then format('low_order_rate ({{:.2f}} < 0.25)', order_rate) end,
      case when n_missing > 1 then 'too_many_unmatched (' || n_missing || ' > 1)' end,
      case when mean_sim <> 0 and mean_sim < 0.58 then format('weak_mean_sim ({{:.2f}} < 0.58)', mean_sim) end,
      case when proxy >= 0.6 then format('high_proxy_step_fraction ({{:.2f}})', proxy) end,
      case when told >= 0.5 then format('intention_step_recitation ({{:.2f}} >= 0.50)', told) end,
      case when match_rate >= 0.95 and not traced then 'high_match_without_execution_trace' end,
      case when confidence < 0.5 then format('low_confidence ({{:.2f}} < 0.5)', confidence) end], lambda x: x is not null) as reasons from conf)"""

_RLVR = rf"""r as (select row_id, {strip("reward_model.ground_truth")} as g, coalesce(solution_str, '') as sol from rlvr_rows),
  p as (select row_id, sol, regexp_matches(sol, '(?s)<think>.*?</think>') as thinks, case when g like '{{%' and json_valid(g) then json_extract_string(g, '$.reference_steps[*]') when g like '[%' and json_valid(g) then json_extract_string(g, '$[*]') else [] end as s,
    case when g like '{{%' then 'ground_truth.reference_steps' else 'ground_truth' end as src from r),
  inp as (select row_id as id, src, case when thinks then {strip("substr(sol, strpos(sol, '</think>') + 8)")} else {strip("sol")} end as response,
    case when thinks then length({strip("regexp_extract(sol, '(?s)<think>(.*?)</think>', 1)")}) else 0 end as think_len,
    list_transform(list_filter(list_transform(coalesce(s, []), lambda x: {strip("x")}), lambda x: x <> ''), lambda x: [x]) as steps from p)"""
_REPEATED = f"""pieces as (select id, list_filter(regexp_split_to_array(coalesce(response, ''), '[，,。；;！!？?]|{WS}'), lambda x: length(x) > 3) as x from inp),
  counted_pieces as (select id, len(x) as n, len(list_distinct(x)) as d, len(list_filter(range(1, len(x)), lambda i: x[i] = x[i + 1])) as c from pieces),
  repeated as (select id, case when n > 1 then (n - d) / n else 0.0 end as rate,
    cast(case when n > 1 then -(c * 0.3 + greatest(n - d - c, 0) * 0.1) - (case when d / n < 0.3 then 0.5 else 0.0 end) else 0.0 end as double) as penalty from counted_pieces)"""
_LABELS = "list_transform(steps, lambda s: array_to_string(s, ' | '))"

# ------------------------------------------------------------------ tool calls

_OBJ = "case when {0} like '{{%' and json_valid({0}) then {0} end"


def obj(x: str) -> str:
    return "(" + _OBJ.format(x) + ")"


def get(x: str, *names: str) -> str:
    return "coalesce(" + ", ".join(f"json_extract_string({obj(x)}, '$.{n}')" for n in names) + ", null)"


def truthy(x: str, *names: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(json_extract_string({obj(x)}, '$.{n}'), '')" for n in names) + ", null)"


def _named(*aliases: str) -> str:
    return rf"regexp_matches(name, '(?:^|[./:-]|__)(?:{'|'.join(aliases)})$')"


CALLS = f"""calls as (select distinct * from tool_calls), raw as (select *, lower(tool_name) as name,
    {strip(f"coalesce(case when {obj('arguments')} is not null then {get('arguments', 'command', 'cmd')} when arguments not like '[%' then arguments end, '')")} as cmd,
    {strip("coalesce(" + truthy("arguments", "path", "file_path", "file") + ", '')")} as path,
    (error is not null or coalesce(exit_code <> 0, false)) as bad, 'exit code: ' || exit_code as ec, 'error: ' || nullif(error, '') as er,
    coalesce(nullif(concat_ws(chr(10), {", ".join(f"json_extract_string({obj('output')}, '$.{n}')" for n in ("stdout", "stderr", "text", "output", "content"))}), ''), output, '') as txt from calls),
  named as (select *, case when contains(name, 'pytest') or contains(lower(cmd), 'pytest') then 'pytest'
    when {_named(*_T.SHELL)} then 'shell' when {_named(*_T.READ)} then 'file_read'
    when {_named(*_T.WRITE)} then 'file_write'
    when {_named(*_T.BROWSER)} or list_contains(regexp_split_to_array(name, '[^a-z0-9]+'), 'browser') then 'browser'
    when {_named(*_T.HTTP)} then 'http' else 'generic' end as handler,
    list_transform(regexp_extract_all(txt, '(?i)\\b\\d+\\s+(?:passed|failed|errors|error|skipped|xfailed|xpassed)\\b'), lambda x: lower(regexp_replace(x, '\\s+', ' ', 'g'))) as sums,
    try_cast(coalesce({get("metadata", "status_code")}, {get("output", "status_code", "status")}) as int) as code from raw)"""


def _tool(handler: str, action: str, evidence: str, bad: str, if_bad: str, if_good: str) -> str:
    return f"""with {CALLS} select traj_id, ord, call_id, {action} as action, {evidence} as evidence,
      case when {bad} then '{if_bad}' else '{if_good}' end as outcome, case when {bad} then 'failure' else 'success' end as status from named where handler = '{handler}'"""


#: Action, evidence, failure, and the outcomes of failure and success of each family.
FAMILIES: dict[str, tuple[str, ...]] = {
    "pytest": ("'run tests'",
        "coalesce(nullif(concat_ws('; ', 'pytest command: ' || nullif(cmd, ''), 'pytest result: ' || nullif(array_to_string(sums, ', '), ''), ec, er), ''), 'pytest executed')",
        "(bad or len(list_filter(sums, lambda x: regexp_matches(x, '^0*[1-9][0-9]* (?:failed|errors?)$'))) > 0)", "tests fail", "tests pass",
    ),
    "shell": ("'run shell command'", "concat_ws('; ', coalesce('command: ' || nullif(cmd, ''), 'shell command executed'), ec, er)", "bad", "command failed", "command succeeded"),
    "file_read": ("concat_ws(' ', 'read file', nullif(path, ''))", "coalesce('file path: ' || nullif(path, ''), nullif(error, ''), 'file read requested')", "bad", "file read failed", "file contents observed"),
    "file_write": ("coalesce('modify file ' || nullif(path, ''), 'modify repository files')", "concat_ws('; ', coalesce('file path: ' || nullif(path, ''), 'patch or file update submitted'), er)", "bad", "file modification failed", "file modified"),
    "browser": (f"case when contains(lower(coalesce({get('arguments', 'operation', 'action')}, name)) || ' ' || name, 'search') then 'search the web' when contains(lower(coalesce({get('arguments', 'operation', 'action')}, name)) || ' ' || name, 'click') then 'interact with web page' else 'open web page' end",
        f"concat_ws('; ', coalesce('browser target: ' || {truthy('arguments', 'url', 'query', 'target')}, 'browser action recorded'), er)", "bad", "browser action failed", "browser action completed",
    ),
    "http": (f"'send ' || upper(coalesce({get('arguments', 'method')}, 'GET')) || ' HTTP request'",
        f"coalesce(nullif(concat_ws('; ', 'url: ' || {truthy('arguments', 'url')}, 'status code: ' || code, ec, er), ''), 'HTTP request recorded')", "(bad or coalesce(code >= 400, false))", "HTTP request failed", "HTTP request succeeded",
    ),
    "generic": ("'use tool ' || tool_name", "concat_ws('; ', 'tool: ' || tool_name, ec, er)", "bad", "tool call failed", "tool call succeeded"),
}
_SECRET = r"""'("(?:api_key|apikey|authorization|cookie|password|secret|token|[^"]*(?:_token|_secret|_password|_key))"\s*:\s*)"[^"]*"'"""

# --------------------------------------------------------------------- events

EVENTS = f"""latest as (
    select * from trace_events where traj_id is not null and ord is not null
    qualify row_number() over (partition by traj_id, ord order by ingested_at desc nulls last) = 1),
  wfs as (select traj_id, json_extract_string(metadata, '$.workflow') as wf, count(*) as c from latest group by all having wf is not null),
  top as (select traj_id, wf as workflow from wfs qualify row_number() over (partition by traj_id order by c desc, wf) = 1),
  ev as (select l.* exclude (node_id, transition_kind), nullif({strip("node_id")}, '') as node_id, nullif({strip("transition_kind")}, '') as transition_kind, t.workflow
    from latest l left join top t on l.traj_id = t.traj_id)"""
KNOWN = f"""{EVENTS},
  k0 as (select e.* from ev e where exists (select 1 from workflow_nodes n where n.workflow = e.workflow and n.id = e.node_id)),
  k1 as (select *, coalesce(lag(node_id) over (partition by traj_id order by ord) <> node_id, true) as opens from k0),
  k2 as (select *, sum(case when opens and occurrence is null then 1 else 0 end) over (partition by traj_id, node_id order by ord) as sum_a from k1),
  k3 as (select *, max(occurrence - sum_a) over (partition by traj_id, node_id order by ord) as peak from k2),
  k4 as (select *, case when opens then coalesce(occurrence, sum_a + greatest(0, coalesce(peak, 0))) else occurrence end as given from k3),
  known as (select *, last_value(given ignore nulls) over (partition by traj_id order by ord rows between unbounded preceding and current row) as occ from k4)"""
VISITS = f"""{KNOWN},
  v0 as (select *, case when lag(node_id) over w = node_id and lag(occ) over w = occ then 0 else 1 end as fresh from known window w as (partition by traj_id order by ord)),
  v1 as (select *, sum(fresh) over (partition by traj_id order by ord) as visit from v0),
  visits as (select traj_id, workflow, visit, node_id, occ, min(ord) as first_ord, count(*) as n_events, min(transition_kind) as kind, count(distinct transition_kind) as n_kinds from v1 group by all)"""
MOVES = f"""{VISITS},
  m0 as (select *, lag(node_id) over (partition by traj_id order by visit) as source, lag(visit) over (partition by traj_id order by visit) as pv from visits),
  m1 as (select m.traj_id, m.workflow, m.visit, m.source, m.node_id, m.occ, m.kind, m.n_kinds, min(e.edge_index) as edge_index, count(e.edge_index) as n_edges
    from m0 m left join workflow_edges e on e.workflow = m.workflow and e.source = m.source and e.target = m.node_id and (m.kind is null or e.kind = m.kind) where pv is not null group by all),
  moves as (select m.*, e.kind as edge_kind, e.max_traversals, case when m.edge_index is not null then row_number() over (partition by traj_id, m.edge_index order by visit) end as taken
    from m1 m left join workflow_edges e on e.workflow = m.workflow and e.edge_index = m.edge_index)"""
CHECKS = f"""{MOVES},
  ends as (select traj_id, arg_min(node_id, visit) as first, arg_max(node_id, visit) as last from visits group by traj_id),
  whole as (select distinct e.traj_id, e.workflow, x.first, x.last, d.start, d.terminals from ev e left join ends x on x.traj_id = e.traj_id left join workflow_defs d on d.name = e.workflow),
  checks as (
    select traj_id, max(c) <= 1 as passed, 'duplicate_event_id' as reason from (select traj_id, event_id, count(*) as c from ev group by all) group by traj_id
    union all select traj_id, coalesce(trusted and source in ('runtime', 'external'), false), 'untrusted_event:' || event_id from ev
    union all select traj_id, false, 'missing_node_id:' || event_id from ev where node_id is null
    union all select traj_id, false, 'unknown_node:' || node_id from ev e where node_id is not null and not exists (select 1 from workflow_nodes n where n.workflow = e.workflow and n.id = e.node_id)
    union all select traj_id, true, null from known
    union all select traj_id, false, 'no_mapped_workflow_path' from whole where first is null
    union all select traj_id, coalesce(first = start, false), 'wrong_start:' || first from whole where first is not null
    union all select traj_id, coalesce(list_contains(terminals, last), false), 'terminal_not_reached:' || coalesce(last, '<none>') from whole
    union all select traj_id, occ = nth, 'non_sequential_occurrence:' || node_id || ':' || occ || '!=' || nth from (select *, row_number() over (partition by traj_id, node_id order by visit) as nth from visits)
    union all select v.traj_id, v.c <= n.max_visits, 'node_visit_limit_exceeded:' || v.node_id || ':' || v.c || '>' || n.max_visits
      from (select traj_id, workflow, node_id, count(*) as c from visits group by all) v join workflow_nodes n on n.workflow = v.workflow and n.id = v.node_id
    union all select traj_id, n_kinds <= 1, 'conflicting_transition_kinds:' || node_id || '#' || occ from moves
    union all select traj_id, false, 'illegal_transition:' || source || '->' || node_id || coalesce(':' || kind, '') from moves where edge_index is null
    union all select traj_id, taken <= max_traversals, 'edge_traversal_limit_exceeded:' || source || '->' || node_id || ':' || taken || '>' || max_traversals from moves where edge_index is not null)"""

_CHAIN = ["ev", "k0", "k1", "k2", "k3", "k4", "known", "v0", "v1", "visits", "m0", "m1", "moves", "ends", "whole", "checks"]
_PER_UNIT = re.sub(r"\b(" + "|".join(_CHAIN) + r")\b", r"u_\1", CHECKS[len(EVENTS) :])
WALKS = f"""{KNOWN}, z0 as (select *, lag(node_id) over (partition by traj_id order by ord) as before from known),
  z1 as (select e.*, sum(case when z.node_id = d.start and (z.before is null or z.before <> z.node_id) then 1 else 0 end) over (partition by e.traj_id order by e.ord) as attempt
    from ev e join workflow_defs d on d.name = e.workflow left join z0 z on z.traj_id = e.traj_id and z.ord = e.ord),
  z2 as (select *, (row_number() over (partition by traj_id, attempt order by ord) - 1) // 1000 as part from z1),
  units as (select traj_id as traj, attempt, part, traj_id || '#' || attempt || '#' || part as unit, count(*) as n, count(*) filter (where coalesce(trusted and source in ('runtime', 'external'), false)) as trusted from z2 group by all),
  u_ev as (select * exclude (traj_id, attempt, part), traj_id || '#' || attempt || '#' || part as traj_id from z2){_PER_UNIT},
  tally as (select traj_id, count(*) filter (where passed) as good, count(*) as all_checks, bool_and(passed) as valid from u_checks group by traj_id),
  ways as (select traj_id, string_agg(node_id || '#' || occ, '>' order by visit) as path, arg_max(node_id, visit) as last from u_visits group by traj_id),
  warned as (select traj_id, count(*) as c from u_moves where n_edges > 1 and kind is null group by traj_id)"""

def _schema(nodes: str, edges: str, defs: str, before: str = "") -> str:
    """Everything that breaks the schema in three tables, which ``before`` may define."""
    rows = [
        f"select workflow, 'empty_node_id' as problem, cast(node_index as varchar) as item from {nodes} where id is null or trim(id) = ''",
        f"select workflow, 'empty_action', id from {nodes} where action is null or len(list_filter(action, lambda a: trim(a) <> '')) = 0",
        f"select workflow, 'bad_weight', id from {nodes} where weight is null or weight <= 0",
        f"select workflow, 'bad_max_visits', id from {nodes} where max_visits is null or max_visits <= 0",
        f"select workflow, 'duplicate_node_id', id from {nodes} group by workflow, id having count(*) > 1",
        f"select workflow, 'unsupported_kind', cast(edge_index as varchar) from {edges} where coalesce(lower(trim(kind)), '') not in ('forward', 'alternative', 'retry', 'recovery', 'rollback')",
        f"select workflow, 'bad_max_traversals', cast(edge_index as varchar) from {edges} where max_traversals is null or max_traversals <= 0",
        *(f"select workflow, 'unknown_{c}', {c} from {edges} e where not exists (select 1 from {nodes} n where n.workflow = e.workflow and n.id = e.{c})" for c in ("source", "target")),
        f"select name, 'unknown_start', start from {defs} d where not exists (select 1 from {nodes} n where n.workflow = d.name and n.id = d.start)",
        f"select name, 'no_terminal', null from {defs} where coalesce(len(terminals), 0) = 0",
        f"select d.name, 'unknown_terminal', t.x from {defs} d, unnest(d.terminals) t(x) where not exists (select 1 from {nodes} n where n.workflow = d.name and n.id = t.x)",
        f"select workflow, 'no_required_node', null from {nodes} group by workflow having not bool_or(required)",
        f"select name, 'bad_stage_weight', m.e.key from (select name, unnest(map_entries(stage_weights)) as e from {defs}) m where m.e.value <= 0",
    ]
    return (f"with {before} " if before else "") + " union all ".join(rows)


_FILLED = "case when regexp_replace(coalesce({0}, ''), '\\s', '', 'g') in ('', '{{}}', 'null') then null else {0} end"

SQL: dict[str, str] = {
    "normalize_steps": f"with {STEPS}, {numbered('x', '(select id, steps from stepped)', 'steps', 'step')} select id, cast(pos as int) as step_index, {label('step')} as label, cast(len(step) as int) as n_candidates from x",
    "resolve_steps": rf"""with r as (select row_id, {strip("reward_model.ground_truth")} as g, reward_model.ground_truth as raw from rlvr_rows),
      p as (select row_id, case when g like '{{%' and json_valid(g) then json_extract_string(g, '$.reference_steps[*]') when g like '[%' and json_valid(g) then json_extract_string(g, '$[*]') else [] end as s,
        case when g like '{{%' then 'ground_truth.reference_steps' else 'ground_truth' end as src from r),
      q as (select row_id, src, list_filter(list_transform(coalesce(s, []), lambda x: {strip("x")}), lambda x: x <> '') as s from p)
      select row_id, case when len(s) > 0 then src end as source, len(s) as n_steps, array_to_string(s, ' || ') as labels from q""",
    "classify_steps": f"with {SAMPLES}, {numbered('x', '(select id, reference_steps from samples)', 'reference_steps', 'step')}, y as (select id, pos, list_filter(coalesce(step, []), lambda c: {strip('c')} <> '') as step from x) select id, cast(pos as int) as step_index, {tiers('step')} as tier from y",
    "label_coercion": f"with {SAMPLES} select id, label from samples",
    "resolve_paths": """select row_id, case when row_id % 11 < 10 then 'extra_info.' || (['reference_steps', 'actions', 'metadata.reference_steps', 'metadata.actions', 'rlvr.reference_steps', 'rlvr.actions', 'ground_truth.reference_steps',
        'ground_truth.actions', 'reward_model.ground_truth.reference_steps', 'reward_model.ground_truth.actions'])[row_id % 11 + 1] end as source,
      case when row_id % 11 < 10 then 'open ' || row_id || ' || close ' || row_id else '' end as labels from rlvr_rows""",
    "sliding_windows": f"with recursive {windows(48, 24)}, {kept(256)} select id, cast(i as int) as win, cast(s as int) as start_char, cast(e as int) as end_char, md5(substr(t, s + 1, e - s)) as text_md5 from capped",
    "window_coverage": f"""with recursive {windows(128, 64)}, {kept(32)},
      reach as (select *, max(e) over (partition by id order by i rows between unbounded preceding and 1 preceding) as before from capped),
      per as (select id, any_value(n) as n, any_value(m) as m, count(*) as k, sum(greatest(0, e - greatest(s, coalesce(before, 0)))) as cov, max(e) as last from reach group by id)
      select z.id, cast(z.n as int) as input_chars, cast(coalesce(p.m, 0) as int) as candidate_windows, cast(coalesce(p.k, 0) as int) as num_windows, coalesce(p.m > p.k, false) as windows_downsampled,
        cast(coalesce(p.cov, 0) as int) as covered_chars, round(case when z.n > 0 then p.cov / z.n else 0.0 end, 6) as coverage_rate, coalesce(p.last = z.n, false) as tail_covered
      from sized z left join per p on p.id is not distinct from z.id""",
    "window_downsample": f"with recursive {windows(48, 24)}, {kept(8)} select id, cast(row_number() over (partition by id order by i) - 1 as int) as slot, cast(i as int) as win from capped",
    "passage_windows": f"""with {SAMPLES}, {numbered("x", "(select id, string_split(response, chr(10)) as turns from samples where response is not null)", "turns", "turn_text")},
      y as (select id, pos, length({strip("turn_text")}) as k from x), z as (select *, coalesce(sum(k + 1) over (partition by id order by pos rows between unbounded preceding and 1 preceding), 0) as st from y)
      select id, cast(pos as int) as turn, cast(st as int) as start, cast(st + k as int) as "end" from z where k > 0""",
    "cosine_matrix": """select q.vec_id as query_id, e.vec_id, round(list_dot_product(cast(q.embedding as double[]), cast(e.embedding as double[])), 5) as cosine
      from embeddings q, embeddings e where q.vec_id % 100 = 0 and q.embedding is not null and e.embedding is not null""",
    "embed_distinct": f"""with recursive {SAID}
      select role, md5(text) as text_md5, cast(case when {mask('text')} > 0 then 1.0 else 0.0 end as double) as squared_norm from (select distinct role, text from said)""",
    "encoding_stats": f"with recursive {SAID} select role, count(*) as asked, count(distinct text) as encoded, round(1 - count(distinct text) / count(*), 6) as hit_rate from said group by role",
    "embedding_lookup": f"""with {STEPS}, {numbered("s1", "(select id, steps from stepped)", "steps", "step")}, s2 as (select id, pos, unnest(step) as c, generate_subscripts(step, 1) - 1 as k from s1)
      select id, cast(pos as int) as step, cast(k as int) as candidate, cast(bit_count({mask("c")}) as int) as n_concepts from s2""",
    "candidate_max": f"with recursive {SIMS} select id, cast(step as int) as step, cast(win as int) as win, round(sim, 6) as sim from sims",
    "best_window": f"with recursive {BEST} select id, cast(step as int) as step, cast(win as int) as win, round(sim, 6) as sim from best",
    "match_margin": f"with recursive {BEST} select id, cast(step as int) as step, round(greatest(sim - second, 0.0), 6) as margin from best",
    "order_rate": f"""with recursive {BEST}, up as (select * from best where sim >= 0.45),
      pairs as (select a.id, avg(case when a.win < b.win then 1.0 when a.win = b.win then 0.5 else 0.0 end) as r from up a join up b on a.id = b.id and a.step < b.step group by a.id),
      n as (select b.id, count(*) filter (where sim >= 0.45) as k from best b group by b.id)
      select n.id, round(case when k = 0 then 0.0 when k = 1 then 1.0 else r end, 6) as order_rate from n left join pairs p on p.id = n.id""",
    "monotonic_score": f"""with recursive {SIMS}, rows1 as (select id, step, list(case when sim >= 0.45 then sim else 0.0 end order by win) as g from sims group by id, step),
      dp as (select id, 0 as step, list_transform(g, lambda x: cast(0 as double)) as d from rows1 where step = 0
        union all
        select r.id, dp.step + 1, list_transform(range(1, len(r.g) + 1), lambda i: list_max(list_transform(range(1, i + 1), lambda j:
            greatest(dp.d[j], case when r.g[j] > 0 then (case when j = 1 then 0.0 else dp.d[j - 1] end) + r.g[j] else 0.0 end))))
        from dp join rows1 r on r.id = dp.id and r.step = dp.step),
      last as (select id, arg_max(d[-1], step) as s from dp group by id)
      select s.id, round(coalesce(l.s, 0.0), 3) as alignment_score from samples s left join last l on l.id = s.id""",
    "linear_score": f"""with recursive {SCORED} select id, round(match_rate * order_rate, 6) as score, round(match_rate, 6) as match_rate, round(order_rate, 6) as order_rate, matched as matched_steps,
      cast(len(missing) as int) as n_unmatched, method, round(mean_margin, 6) as mean_margin from chosen""",
    "coarse_to_fine": f"with recursive {SCORED} select id, method, cast(n_hits as int) as n_matched, round(mean_sim, 6) as mean_matched_sim, round(min_sim, 6) as min_matched_sim from chosen",
    "gated_paths": f"""with recursive {SCORED}, denied as (select s.id, s.steps, unnest(list_filter(range(0, len(s.steps)), lambda i: not list_contains(c.missing, i))) as i
        from (select *, {HAS_TRACE} as traced from stepped) s join chosen c on c.id = s.id where not traced)
      select id, cast(i as int) as step, {label("steps[i + 1]")} as label from denied""",
    "linear_routing": f"""with recursive {SCORED}, base as (select s.id, s.response, s.steps, coalesce(s.reference_steps, []) as raw, c.match_rate, c.order_rate, c.mean_sim, c.mean_margin, len(c.missing) as n_missing from stepped s join chosen c on c.id = s.id), {JUDGED}
      select id, round(match_rate * order_rate, 6) as score, round(confidence, 6) as confidence, len(reasons) > 0 as fallback, array_to_string(reasons, '; ') as reasons from judged""",
    "best_trajectory": f"""with recursive {STEPS}, three as (select id, response, unnest([0, 1, 2]) as k, unnest([steps, list_reverse(steps), steps[2:]]) as way from stepped where len(steps) > 1),
      inp as (select id || '#' || k as id, response, way as steps from three), {BOTH},
      ranked as (select t.id, t.k, round(c.match_rate * c.order_rate, 12) as score, round(c.match_rate, 12) as m, round(c.order_rate, 12) as o from three t join chosen c on c.id = t.id || '#' || t.k)
      select id, cast(arg_max(k, (score, m, o, -k)) as int) as best_index, round(max(score), 6) as score, count(*) as n_trajectories from ranked group by id""",
    "final_scores": f"""with recursive {_RLVR}, {BOTH}, {_REPEATED}, base as (select i.id, i.response, i.steps, i.steps as raw, c.match_rate, c.order_rate, c.mean_sim, c.mean_margin, len(c.missing) as n_missing from inp i join chosen c on c.id = i.id), {JUDGED},
      told2 as (select i.*, c.match_rate, c.order_rate, c.names, c.missing, r.rate, r.penalty, j.confidence, j.reasons, len(i.steps) > 0 and i.response <> '' as ok
        from inp i join chosen c on c.id = i.id join repeated r on r.id = i.id join judged j on j.id = i.id)
      select id as row_id, round(greatest(match_rate * order_rate + penalty, 0.0), 6) as score, round(match_rate * order_rate, 6) as semantic_score, round(match_rate, 6) as match_rate, round(order_rate, 6) as order_rate,
        array_to_string(names, '; ') as matched_steps, array_to_string(case when ok then list_transform(missing, lambda i: {_LABELS}[i + 1]) else {_LABELS} end, '; ') as unmatched_steps,
        array_to_string(list_transform(steps, lambda s: {_RAW_TIERS}), '; ') as step_tiers, case when len(steps) > 0 then src end as steps_source, cast(len(steps) as int) as n_steps, cast(think_len as int) as think_len,
        round(rate, 6) as repetition_rate, round(penalty, 6) as penalty, round(case when ok then confidence else 0.0 end, 6) as confidence, case when ok then len(reasons) > 0 else true end as fallback,
        case when ok then array_to_string(reasons, '; ') else 'missing_steps_or_response' end as reasons from told2""",
    "final_scores_lexical": f"""with {_RLVR}, {_REPEATED},
      shared as (select i.*, r.penalty, case when len(steps) > 0 and response <> '' then len(list_filter(steps, lambda s: contains(response, {label("s")}))) / len(steps) else 0.0 end as share from inp i join repeated r on r.id = i.id)
      select id as row_id, round(greatest(share + penalty, 0.0), 6) as score, round(share, 6) as match_rate, true as fallback, case when len(steps) > 0 and response <> '' then 'no_embedding_backend' else 'missing_steps_or_response' end as reasons from shared""",
    "path_enumeration": """with recursive p as (select name as workflow, [start] as nodes, cast([] as int[]) as edges from workflow_defs
        union all
        select p.workflow, list_append(p.nodes, e.target), list_append(p.edges, e.edge_index) from p join workflow_defs d on d.name = p.workflow join workflow_edges e on e.workflow = p.workflow and e.source = p.nodes[-1]
          join workflow_nodes n on n.workflow = p.workflow and n.id = e.target
        where not list_contains(d.terminals, p.nodes[-1]) and len(p.nodes) < 64 and len(list_filter(p.edges, lambda x: x = e.edge_index)) < e.max_traversals and len(list_filter(p.nodes, lambda x: x = e.target)) < n.max_visits),
      q as (select p.workflow, nodes, row_number() over (partition by p.workflow order by edges) - 1 as k, count(*) over (partition by p.workflow) as c from p join workflow_defs d on d.name = p.workflow where list_contains(d.terminals, nodes[-1]))
      select workflow, cast(k as int) as path_index, array_to_string(nodes, '>') as path, cast(len(nodes) as int) as n_nodes, c > 128 as truncated from q where k < 128""",
    "graph_unrolling": """with recursive r as (select distinct workflow, source as a, target as b from workflow_edges union select r.workflow, r.a, e.target from r join workflow_edges e on e.workflow = r.workflow and e.source = r.b),
      loops as (select e.* from workflow_edges e where e.source = e.target or exists (select 1 from r where r.workflow = e.workflow and r.a = e.target and r.b = e.source)),
      looped as (select distinct workflow, unnest([source, target]) as node from loops),
      st as (select name as workflow, start as node, 1 as depth, case when exists (select 1 from looped l where l.workflow = name and l.node = start) then [start] else cast([] as varchar[]) end as seen, cast([] as int[]) as used from workflow_defs
        union
        select st.workflow, e.target, st.depth + 1, case when l.node is not null then list_sort(list_append(st.seen, e.target)) else st.seen end, case when k.edge_index is not null then list_sort(list_append(st.used, e.edge_index)) else st.used end
        from st join workflow_defs d on d.name = st.workflow join workflow_edges e on e.workflow = st.workflow and e.source = st.node join workflow_nodes n on n.workflow = st.workflow and n.id = e.target
          left join looped l on l.workflow = st.workflow and l.node = e.target left join loops k on k.workflow = st.workflow and k.edge_index = e.edge_index
        where not list_contains(d.terminals, st.node) and st.depth < 64 and (k.edge_index is null or len(list_filter(st.used, lambda x: x = e.edge_index)) < e.max_traversals)
          and (l.node is null or len(list_filter(st.seen, lambda x: x = e.target)) < n.max_visits)),
      moved as (select st.workflow, count(*) as c
        from st join workflow_defs d on d.name = st.workflow join workflow_edges e on e.workflow = st.workflow and e.source = st.node join workflow_nodes n on n.workflow = st.workflow and n.id = e.target
          left join looped l on l.workflow = st.workflow and l.node = e.target left join loops k on k.workflow = st.workflow and k.edge_index = e.edge_index
        where not list_contains(d.terminals, st.node) and st.depth < 64 and (k.edge_index is null or len(list_filter(st.used, lambda x: x = e.edge_index)) < e.max_traversals)
          and (l.node is null or len(list_filter(st.seen, lambda x: x = e.target)) < n.max_visits) group by st.workflow)
      select st.workflow, cast(count(*) as int) as states, cast(coalesce(any_value(m.c), 0) as int) as transitions, cast(count(*) filter (where list_contains(d.terminals, st.node)) as int) as terminals,
        coalesce(bool_or(st.depth >= 64 and not list_contains(d.terminals, st.node)), false) as truncated
      from st join workflow_defs d on d.name = st.workflow left join moved m on m.workflow = st.workflow group by st.workflow""",
    "layered_workflows": "select cast(b as int) as branches, cast(l as int) as layers, cast(pow(b, l) as int) as paths, cast(2 + b * l as int) as states, cast(2 * b + b * b * (l - 1) as int) as transitions, true as agree from (values (2, 2), (2, 5), (3, 3), (4, 2)) v(b, l)",
    "schema_problems": _schema("workflow_nodes", "workflow_edges", "workflow_defs"),
    "schema_faults": _schema("fn", "fe", "fd", """n0 as (select * replace (case when node_index = 1 then -1.0 else weight end as weight, case when node_index = 2 then 0 else max_visits end as max_visits,
          case when node_index = 3 then [' '] else action end as action, case when node_index = 4 then 'gone-' || id else id end as id, case when workflow = 'defect_loop' then false else required end as required) from workflow_nodes),
        fn as (select * from n0 union all select * from n0 where node_index = 0),
        fe as (select * replace (case when edge_index = 0 then 'jump' else kind end as kind, case when edge_index = 1 then 0 else max_traversals end as max_traversals, case when edge_index = 2 then 'nowhere' else target end as target) from workflow_edges),
        fd as (select * replace (case when name = 'web_booking' then 'nowhere' else start end as start, case when name = 'web_booking' then [] else terminals end as terminals) from workflow_defs)"""),
    "trace_gate": f"with {STEPS} select id, {HAS_TRACE} as has_trace from stepped",
    "intention_recitation": f"with {STEPS}, {TOLD} select s.id, round(coalesce(t.fraction, 0.0), 6) as fraction from stepped s left join told t on t.id = s.id",
    "confidence_routing": f"{ROUTED} select id, round(confidence, 6) as confidence, len(reasons) > 0 as fallback, array_to_string(reasons, '; ') as reasons from routed",
    "think_split": f"""with t as (select row_id, coalesce(solution_str, '') as s from rlvr_rows), p as (select *, regexp_matches(s, '(?s)<think>.*?</think>') as ok from t)
      select row_id, case when ok then cast(length({strip("regexp_extract(s, '(?s)<think>(.*?)</think>', 1)")}) as int) else 0 end as think_len,
        md5(case when ok then {strip("substr(s, strpos(s, '</think>') + 8)")} else {strip("s")} end) as answer_md5 from p""",
    "repetition_penalty": f"""with {SAMPLES}, p as (select id, list_filter(regexp_split_to_array(coalesce(response, ''), '[，,。；;！!？?]|{WS}'), lambda x: length(x) > 3) as x from samples),
      q as (select id, len(x) as n, len(list_distinct(x)) as d, len(list_filter(range(1, len(x)), lambda i: x[i] = x[i + 1])) as c from p)
      select id, round(case when n > 1 then (n - d) / n else 0.0 end, 6) as rate,
        round(cast(case when n > 1 then -(c * 0.3 + greatest(n - d - c, 0) * 0.1) - (case when d / n < 0.3 then 0.5 else 0.0 end) else 0.0 end as double), 6) as penalty from q""",
    "lexical_coverage": f"with {SAMPLES}, x as (select id, coalesce(reference_steps, []) as steps, {fold(chr(99) + 'oalesce(response, ' + chr(39) * 2 + ')')} as ft from samples) select id, round({_FOLDED.replace(fold('c'), fold('coalesce(c, ' + chr(39) * 2 + ')'))}, 6) as coverage from x",
    "lexical_fallback": f"with {STEPS}, x as (select id, steps, {strip('coalesce(response, ' + chr(39) * 2 + ')')} as a from stepped) select id, round(case when len(steps) > 0 and a <> '' then len(list_filter(steps, lambda s: contains(a, {label('s')}))) / len(steps) else 0.0 end, 6) as share from x",
    "tool_dispatch": f"with {CALLS} select traj_id, ord, call_id, handler from named",
    **{f"{name}_semantics": _tool(name, *parts) for name, parts in FAMILIES.items()},
    "adapted_events": " union all ".join(
        "(" + _tool(name, *parts).replace("select traj_id, ord, call_id,", f"""select traj_id, ord, call_id as event_id, handler, 'runtime' as source, true as trusted, nullif({strip("node_id")}, '') as node_id, occurrence,
          lower(nullif({strip("transition_kind")}, '')) as transition_kind, regexp_replace(arguments, {_SECRET}, '\\1"[REDACTED]"', 'gi') as tool_input, state_after,""", 1) + ")"
        for name, parts in FAMILIES.items()
    ),
    "redact": r"""select distinct traj_id, ord, call_id, regexp_replace(arguments, '("(?:api_key|apikey|authorization|cookie|password|secret|token|[^"]*(?:_token|_secret|_password|_key))"\s*:\s*)"[^"]*"', '\1"[REDACTED]"', 'gi') as arguments
      from (select distinct * from tool_calls)""".replace("select distinct traj_id, ord, call_id, regexp", "select traj_id, ord, call_id, regexp"),
    "event_trust": f"with {EVENTS} select traj_id, ord, coalesce(trusted and source in ('runtime', 'external'), false) as trusted from ev",
    # event by event, with the largest number of each node so far
    "occurrence_infer": f"""with recursive {EVENTS}, o as (select traj_id, ord, node_id, occurrence, row_number() over (partition by traj_id order by ord) as k from ev e
        where exists (select 1 from workflow_nodes n where n.workflow = e.workflow and n.id = e.node_id)),
      r as (select traj_id, ord, node_id, k, coalesce(occurrence, 1) as occ, map([node_id], [coalesce(occurrence, 1)]) as tops from o where k = 1
        union all
        select traj_id, ord, node_id, k, occ, map_concat(tops, map([node_id], [greatest(occ, coalesce(map_extract(tops, node_id)[1], 0))])) from (
          select o.traj_id, o.ord, o.node_id, o.k, r.tops, coalesce(o.occurrence, case when o.node_id = r.node_id then r.occ else coalesce(map_extract(r.tops, o.node_id)[1], 0) + 1 end) as occ
          from r join o on o.traj_id = r.traj_id and o.k = r.k + 1))
      select traj_id, ord, node_id, cast(occ as bigint) as occ from r""",
    "visit_islands": f"with {VISITS} select traj_id, cast(visit as bigint) as visit, node_id, cast(occ as bigint) as occ, first_ord, n_events from visits",
    "edge_lookup": f"with {MOVES} select traj_id, cast(visit as bigint) as visit, source, node_id as target, edge_index, n_edges, taken from moves",
    "transition_counts": f"with {MOVES} select workflow, edge_kind as kind, count(*) as n from moves where edge_index is not null group by all",
    "visit_limits": f"with {VISITS} select v.traj_id, v.node_id, v.c as visits, n.max_visits from (select traj_id, workflow, node_id, count(*) as c from visits group by all) v join workflow_nodes n on n.workflow = v.workflow and n.id = v.node_id where v.c > n.max_visits",
    "state_observations": f"""with {VISITS}, s0 as (select traj_id, node_id, occ, visit, ord, {_FILLED.format("state_before")} as b, {_FILLED.format("state_after")} as a from v1),
      s1 as (select traj_id, node_id, occ, visit, arg_min(b, ord) filter (where b is not null) as b, arg_max(a, ord) filter (where a is not null) as a from s0 group by all),
      s2 as (select * from s1 where b is not null or a is not null qualify row_number() over (partition by traj_id, node_id, occ order by visit desc) = 1)
      select traj_id, node_id, cast(occ as bigint) as occ, coalesce(b, '{{}}') as before, coalesce(a, '{{}}') as after from s2""",
    "trace_walks": f"""with {WALKS} select u.traj as traj_id, cast(u.attempt as bigint) as attempt, cast(u.part as bigint) as part, cast(u.n as int) as total_events, cast(u.trusted as int) as trusted_events,
        cast(t.good as int) as checks_passed, cast(t.all_checks as int) as checks_total, t.valid, coalesce(list_contains(d.terminals, y.last), false) as terminal_reached, coalesce(y.path, '') as path,
        cast(coalesce(w.c, 0) as int) as n_warnings
      from units u join tally t on t.traj_id = u.unit left join ways y on y.traj_id = u.unit left join warned w on w.traj_id = u.unit
      join (select distinct traj_id, workflow from u_ev) e on e.traj_id = u.unit join workflow_defs d on d.name = e.workflow""",
    "ambiguous_transitions": f"with {MOVES} select traj_id, cast(visit as bigint) as visit, 'ambiguous_transition:' || source || '->' || node_id as warning from moves where n_edges > 1 and kind is null",
    "trace_violations": f"with {CHECKS} select distinct traj_id, reason from checks where not passed",
    "trace_validity": f"with {CHECKS} select traj_id, cast(count(*) filter (where passed) as bigint) as checks_passed, count(*) as checks_total, round(count(*) filter (where passed) / count(*), 6) as validity, bool_and(passed) as valid from checks group by traj_id",
    "potential_shaping": f"""with {KNOWN}, f as (select *, case when ord = min(ord) over (partition by traj_id, node_id) then 1 else 0 end as fresh from known),
      g as (select traj_id, ord, workflow, sum(fresh) over (partition by traj_id order by ord) as seen from f),
      h as (select traj_id, ord, seen / (select count(*) from workflow_nodes n where n.workflow = g.workflow) as phi from g)
      select traj_id, ord, round(phi, 6) as potential, round(0.9 * phi - coalesce(lag(phi) over (partition by traj_id order by ord), 0.0), 6) as shaped_reward from h""",
    "attempts": f"""with {VISITS}, a as (select v.*, sum(case when v.node_id = d.start then 1 else 0 end) over (partition by traj_id order by visit) as attempt from visits v join workflow_defs d on d.name = v.workflow)
      select traj_id, cast(attempt as bigint) as attempt, count(*) as visits, cast(sum(n_events) as bigint) as events, min(first_ord) as first_ord from a group by all""",
    "reachability": """with recursive r as (select name as workflow, start as node from workflow_defs union select r.workflow, e.target from r join workflow_edges e on e.workflow = r.workflow and e.source = r.node)
      select workflow, node from r""",
    "dead_ends": """with recursive r as (select name as workflow, start as node from workflow_defs union select r.workflow, e.target from r join workflow_edges e on e.workflow = r.workflow and e.source = r.node),
      b as (select name as workflow, unnest(terminals) as node from workflow_defs union select b.workflow, e.source from b join workflow_edges e on e.workflow = b.workflow and e.target = b.node)
      select n.workflow, count(*) as nodes, cast(count(*) filter (where not exists (select 1 from r where r.workflow = n.workflow and r.node = n.id)) as bigint) as unreachable,
        cast(count(*) filter (where not exists (select 1 from b where b.workflow = n.workflow and b.node = n.id)) as bigint) as dead_ends from workflow_nodes n group by n.workflow""",
    "contract_weights": """with p as (select workflow, id as node_id, 'action' as part, 0.5 as w from workflow_nodes where len(action) > 0
        union all select workflow, id, 'evidence', 0.25 from workflow_nodes where len(evidence) > 0 union all select workflow, id, 'outcome', 0.25 from workflow_nodes where len(outcome) > 0)
      select workflow, node_id, part, round(cast(w / sum(w) over (partition by workflow, node_id) as double), 6) as weight from p""",
    "auroc": f"""{LABELLED}, p as (select score from scored where label = 1), n as (select score from scored where label = 0)
      select (select count(*) from p) + (select count(*) from n) as count, (select count(*) from p) as positives, (select count(*) from n) as negatives,
        round((select avg(case when p.score > n.score then 1.0 when p.score = n.score then 0.5 else 0.0 end) from p, n), 6) as auroc""",
    "average_precision": f"""{LABELLED}, g as (select score, count(*) filter (where label = 1) as p, count(*) as c from scored where label in (0, 1) group by score),
      h as (select p, sum(p) over (order by score desc) as cp, sum(c) over (order by score desc) as cc from g) select cast((select sum(c) from g) as bigint) as count, round(sum(p * cp / cc) / sum(p), 6) as average_precision from h""",
    "threshold_metrics": f"""{LABELLED}, m as (select count(*) as count, coalesce(avg(score) filter (where label = 1), 0) as pm, coalesce(avg(score) filter (where label = 0), 0) as nm,
        avg(case when (score >= 0.5) = (label = 1) then 1.0 else 0.0 end) as acc, avg(case when score >= 0.5 then 1.0 else 0.0 end) filter (where label = 1) as tpr,
        avg(case when score >= 0.5 then 1.0 else 0.0 end) filter (where label = 0) as fpr from scored where label in (0, 1))
      select count, round(pm, 6) as positive_mean, round(nm, 6) as negative_mean, round(pm - nm, 6) as mean_separation, round(acc, 6) as accuracy, round(tpr, 6) as true_positive_rate, round(fpr, 6) as false_positive_rate from m""",
    "pairwise_accuracy": f"""{LABELLED}, q as (select a.pair_id, case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0.0 end as w from scored a join scored b on a.pair_id = b.pair_id and a.label = 1 and b.label = 0 where a.pair_id <> '')
      select count(distinct pair_id) as groups, count(*) as comparisons, round(avg(w), 6) as accuracy from q""",
    "subtype_report": f"""{LABELLED} select coalesce(subtype, 'unspecified') as subtype, count(*) as count, round(avg(score), 6) as mean_score, round(avg(trusted_score), 6) as mean_trusted_score, round(avg(confidence), 6) as mean_confidence,
        round(avg(case when fallback then 1.0 else 0.0 end), 6) as fallback_rate,
        round(avg(case when score >= 0.5 then 1.0 else 0.0 end) filter (where label = 0), 6) as semantic_false_accept_rate, round(avg(case when trusted_score >= 0.5 then 1.0 else 0.0 end) filter (where label = 0), 6) as routed_false_accept_rate,
        round(avg(case when score < 0.5 then 1.0 else 0.0 end) filter (where label = 1), 6) as semantic_false_reject_rate, round(avg(case when trusted_score < 0.5 then 1.0 else 0.0 end) filter (where label = 1), 6) as routed_false_reject_rate
      from scored group by all""",
    "quality_report": f"""{ROUTED}, folded as (select *, {fold("coalesce(response, '')")} as ft from routed),
      qs as (select label, coalesce(subtype, 'unspecified') as subtype, pair_id, confidence, len(reasons) > 0 as fallback, rate as semantic, {_FOLDED} as lexical, not coalesce(traced, false) as denied from folded),
      q as (select *, case when fallback then 0.0 else semantic end as routed from qs),
      sets as (select 'semantic' as block, label, pair_id, semantic as x from q union all select 'routed', label, pair_id, routed from q union all select 'lexical', label, pair_id, lexical from q),
      ranked as (select p.block, avg(case when p.x > n.x then 1.0 when p.x = n.x then 0.5 else 0.0 end) as auroc from sets p join sets n on p.block = n.block and p.label = 1 and n.label = 0 group by p.block),
      g as (select block, x, count(*) filter (where label = 1) as p, count(*) as c from sets where label in (0, 1) group by block, x),
      h as (select block, p, sum(p) over (partition by block order by x desc) as cp, sum(c) over (partition by block order by x desc) as cc from g),
      prec as (select block, sum(p * cp / cc) / sum(p) as ap from h group by block),
      cut as (select block, avg(x) filter (where label = 1) as pm, avg(x) filter (where label = 0) as nm, avg(case when (x >= 0.5) = (label = 1) then 1.0 else 0.0 end) as acc,
        avg(case when x >= 0.5 then 1.0 else 0.0 end) filter (where label = 1) as tpr, avg(case when x >= 0.5 then 1.0 else 0.0 end) filter (where label = 0) as fpr from sets where label in (0, 1) group by block),
      pw as (select a.block, count(distinct a.pair_id) as groups, count(*) as comparisons, avg(case when a.x > b.x then 1.0 when a.x = b.x then 0.5 else 0.0 end) as accuracy
        from sets a join sets b on a.block = b.block and a.pair_id = b.pair_id and a.label = 1 and b.label = 0 where a.pair_id <> '' group by a.block),
      sub as (select subtype, count(*) as n, avg(semantic) as a, avg(routed) as b, avg(confidence) as c, avg(case when fallback then 1.0 else 0.0 end) as d,
        avg(case when semantic >= 0.5 then 1.0 else 0.0 end) filter (where label = 0) as e, avg(case when routed >= 0.5 then 1.0 else 0.0 end) filter (where label = 0) as f,
        avg(case when semantic < 0.5 then 1.0 else 0.0 end) filter (where label = 1) as g, avg(case when routed < 0.5 then 1.0 else 0.0 end) filter (where label = 1) as h from q group by subtype),
      out as (
        select 'dataset' as block, unnest(['count', 'labeled', 'positives', 'negatives']) as metric, unnest([count(*), count(*) filter (where label in (0, 1)), count(*) filter (where label = 1), count(*) filter (where label = 0)]) as value from q
        union all select 'routing', unnest(['positive_fallback_rate', 'negative_fallback_rate', 'positive_trace_denial_rate', 'negative_trace_denial_rate']), unnest([
          coalesce(avg(fallback::int) filter (where label = 1), 0), coalesce(avg(fallback::int) filter (where label = 0), 0), coalesce(avg(denied::int) filter (where label = 1), 0), coalesce(avg(denied::int) filter (where label = 0), 0)]) from q
        union all select r.block, unnest(['auroc', 'average_precision']), unnest([r.auroc, p.ap]) from ranked r join prec p on p.block = r.block
        union all select block, unnest(['positive_mean', 'negative_mean', 'mean_separation', 'accuracy', 'true_positive_rate', 'false_positive_rate']), unnest([pm, nm, pm - nm, acc, tpr, fpr]) from cut
        union all select block || '_pairwise', unnest(['groups', 'comparisons', 'accuracy']), unnest([groups, comparisons, accuracy]) from pw
        union all select 'subtype:' || subtype, unnest(['count', 'mean_score', 'mean_trusted_score', 'mean_confidence', 'fallback_rate', 'semantic_false_accept_rate', 'routed_false_accept_rate', 'semantic_false_reject_rate', 'routed_false_reject_rate']),
          unnest([n, a, b, c, d, e, f, g, h]) from sub)
      select block, metric, round(cast(value as double), 6) as value from out""",
    "top_n_scores": f"{LABELLED} select id, round(score, 6) as score from scored order by score desc, id limit 20",
    "denied_steps": f"with {STEPS}, d as (select id, list_transform({_HIT}, lambda s: {label('s')}) as h from stepped where not ({HAS_TRACE})) select id, unnest(h) as step from d",
    "episode_summary": """select domain, ablation, seed, count(*) as episodes, round(avg(case when success then 1.0 else 0.0 end), 6) as success_rate, round(avg(outcome_reward), 6) as mean_outcome_reward, round(avg(process_reward), 6) as mean_process_reward,
        round(avg(total_reward), 6) as mean_total_reward, round(avg(turns), 6) as mean_turns, round(avg(case when invalid_transitions > 0 then 1.0 else 0.0 end), 6) as invalid_transition_rate, round(avg(wall_time_seconds), 6) as mean_wall_time_seconds
      from episodes group by all""",
    "run_matrix": "select d.domain, a.ablation, s.seed from (values ('code'), ('browser'), ('tool')) d(domain), (values ('outcome_only'), ('linear_terminal'), ('graph_terminal'), ('graph_turn_potential')) a(ablation), (values (1), (2), (3)) s(seed)",
    "token_rewards": "select episode_id, cast(k * 10 - 1 as int) as token, round(process_reward / turns, 6) as reward from episodes, unnest(generate_series(1, turns)) u(k) where turns > 0 and process_reward <> 0",
    "stream_counts": """with o as (select distinct traj_id, ord, ts, metadata from trace_events) , p as (select traj_id, ord, ts, any_value(metadata) as metadata from o group by all)
      select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as hour, coalesce(json_extract_string(metadata, '$.workflow'), 'none') as workflow, count(*) as n from p group by all""",
}
