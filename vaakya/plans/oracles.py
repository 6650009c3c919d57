"""DuckDB SQL for the queries whose operators fold, align or vote."""

from __future__ import annotations

from ..functions import lexicon as L
from ..functions import text
from .utterances import WORDS
from .utterances import sql as utterances_sql

_BLANK = "[ \\t\\n\\r\\x0b\\x0c]+"
_ROMAN = "^[a-zA-Z]{2,}([^\\pL\\pN_]|$)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


def _map(values: dict) -> str:
    return f"map({_list(values)}, [{', '.join(_q(v) if isinstance(v, str) else str(v) for v in values.values())}])"


def _tok(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '{_BLANK}'), lambda t: t <> '')"


_U = f"{utterances_sql()}, pairs as (" + " union all ".join(f"select utt_id, 'model_{k}' as model_id, reference, model_{k} as prediction from utterances" for k in range(1, 6)) + ")"
#: Characters of the words as ASCII, for the built-in distance, which compares bytes.
_CHARS = "".join(dict.fromkeys("".join(WORDS)))
_ASCII = "".join(chr(c) for c in range(33, 33 + len(_CHARS)))


def _chars_apart(a: str, b: str) -> str:
    code = lambda t: f"translate({t}, {_q(_CHARS)}, {_q(_ASCII)})"
    return f"levenshtein({code(a)}, {code(b)})"


def _paths(name: str, source: str) -> str:
    """Recursive tables: ``name`` (id, c, p) has cost and path for each (id, r, h) of ``source``; a row of the table at a time."""
    cell = """case when r[i + 1] = x[1].p then {'c': row[len(acc)].c, 'p': row[len(acc)].p || 'M'}
when row[len(acc)].c = least(row[len(acc)].c, row[len(acc) + 1].c, acc[len(acc)].c) then {'c': row[len(acc)].c + 1, 'p': row[len(acc)].p || 'S'}
when row[len(acc) + 1].c = least(row[len(acc) + 1].c, acc[len(acc)].c) then {'c': row[len(acc) + 1].c + 1, 'p': row[len(acc) + 1].p || 'D'}
else {'c': acc[len(acc)].c + 1, 'p': acc[len(acc)].p || 'I'} end"""
    return f"""{name}_rows as (select id, r, h, 0 as i, list_transform(range(0, len(h) + 1), lambda j: {{'c': j, 'p': repeat('I', j)}}) as row from {source}
union all select id, r, h, i + 1, list_reduce(list_prepend([{{'c': row[1].c + 1, 'p': row[1].p || 'D'}}], list_transform(h, lambda b: [{{'c': 0::bigint, 'p': b}}])), lambda acc, x: list_append(acc, {cell})) from {name}_rows where i < len(r)),
{name} as (select id, r, h, row[len(row)].c as c, row[len(row)].p as p from {name}_rows where i = len(r))"""


_OPS = """list_transform(range(1, len(p) + 1), lambda k: {'op': p[k], 'i': length(regexp_replace(p[:k - 1], '[^MSD]', '', 'g')), 'j': length(regexp_replace(p[:k - 1], '[^MSI]', '', 'g'))})"""
_ALL = f"ids as (select row_number() over (order by utt_id, model_id) as id, *, {_tok('reference')} as r, {_tok('prediction')} as h from pairs), {_paths('ed', 'ids')}"
_HEAD = f"with recursive {_U}, {_ALL} "

EDIT_OPS = _HEAD + "select utt_id, model_id, p as path, " + ", ".join(f"length(regexp_replace(p, '[^{c}]', '', 'g')) as n_{c.lower()}" for c in "MSDI") + " from ed join ids using (id)"

_MATRIX = f"""cells as (select utt_id, cast(right(model_id, 1) as int) as row, list_transform({_OPS}, lambda o: case when o.op <> 'D' then ed.h[o.j + 1] end)[:len(ed.r)] as w from ed join ids using (id)
union all select utt_id, 0, {_tok('reference')} from utterances),
matrix as (select utt_id, row, cast(unnest(range(0, len(w))) as int) as pos, unnest(w) as word from cells)"""
ALIGN_MATRIX = _HEAD + f", {_MATRIX} select utt_id, row, pos, word from matrix"

_SAME = [a + "=" + b for pair in L.SAME_WORDS for a, b in (tuple(pair), tuple(pair)[::-1])]


def _meaning(a: str, b: str) -> str:
    digits = _map(L.DIGITS)
    return f"(coalesce({digits}[{a}] = {b}, false) or coalesce({digits}[{b}] = {a}, false) or {a} || '=' || {b} in ({', '.join(map(_q, _SAME))}))"


_BINS = f"""votes as (select utt_id, pos, word, count(*) * 1.0::double as votes, min(row) as first, count(*) filter (row > 0) as agree, min(row) filter (row > 0) as first_model, max((row = 0)::int) as is_ref
from matrix where word is not null group by all),
shared as (select a.*, greatest(a.votes / 6.0::double, coalesce((select max(b.votes / 6.0::double) from votes b where b.utt_id = a.utt_id and b.pos = a.pos and {_meaning('a.word', 'b.word')}), 0)) as conf from votes a),
tops as (select utt_id, pos, arg_min(word, agree * -100 + first_model) as top, max(agree) as most, arg_min(is_ref, agree * -100 + first_model) as top_ref from votes where agree > 0 group by all),
refs as (select utt_id, pos, max(is_ref) as has_ref from votes group by all),
settled as (select s.*, case when has_ref = 1 and most >= 3 and top_ref = 0 then case when word = top then greatest(conf, most / 5.0::double) when is_ref = 1 then conf * 0.5::double else conf end else conf end as confidence
from shared s join refs using (utt_id, pos) left join tops using (utt_id, pos)),
bins as (select utt_id, pos, word, votes, confidence, row_number() over (partition by utt_id, pos order by confidence desc, is_ref desc, first) = 1 as is_best from settled)"""
LATTICE_BINS = _HEAD + f", {_MATRIX}, {_BINS} select utt_id, pos, word, votes, confidence, is_best from bins"

_LATTICE_WER = f"""cols as (select utt_id, pos, max(word) filter (is_best) as best, list(word) as words from bins group by all),
flat as (select utt_id, list(best order by pos) as best, list(words order by pos) as words from cols group by all),
lids as (select id, utt_id, model_id, best as r, h, words from ids join flat using (utt_id)),
{_paths('le', 'lids')},
rates as (select utt_id, model_id, case when len(ids.r) > 0 then ed.c / len(ids.r) else 0 end as standard_wer,
case when len(lids.r) > 0 then len(list_filter({_OPS.replace('p[', 'le.p[').replace('len(p)', 'len(le.p)')}, lambda o: o.op <> 'M' and not coalesce(o.op = 'S' and list_contains(words[o.i + 1], le.h[o.j + 1]), false))) / len(lids.r) else 0 end as lattice_wer
from le join lids using (id, utt_id, model_id) join ids using (id, utt_id, model_id) join ed using (id))""".replace("join lids using (id, utt_id, model_id)", "join lids using (id)").replace("select utt_id, model_id, case when len(ids.r)", "select ids.utt_id, ids.model_id, case when len(ids.r)").replace("join ids using (id, utt_id, model_id)", "join ids using (id)")
LATTICE_WER = _HEAD + f", {_MATRIX}, {_BINS}, {_LATTICE_WER} select utt_id, model_id, round(standard_wer, 9) as standard_wer, round(lattice_wer, 9) as lattice_wer from rates"
MODEL_SUMMARY = _HEAD + f""", {_MATRIX}, {_BINS}, {_LATTICE_WER} select model_id, round(avg(standard_wer), 9) as mean_standard, round(avg(lattice_wer), 9) as mean_lattice,
count(*) filter (lattice_wer < standard_wer) as improved, count(*) filter (lattice_wer = standard_wer) as unchanged, count(*) filter (lattice_wer > standard_wer) as worsened from rates group by model_id"""

_ALIKE = [a + b for pair in L.ALIKE for a, b in (tuple(pair), tuple(pair)[::-1])]
PHONETIC = _HEAD + f""", {_MATRIX}, d as (select distinct utt_id, pos, word from matrix where word is not null),
w as (select a.word as word_a, b.word as word_b, count(*) as columns from d a join d b using (utt_id, pos) where a.word < b.word group by all)
select word_a, word_b, columns, round(least(1.0, 1 - {_chars_apart('word_a', 'word_b')} / greatest(length(word_a), length(word_b))
+ 0.1 * len(list_filter(range(1, least(length(word_a), length(word_b)) + 1), lambda i: word_a[i] || word_b[i] in ({', '.join(map(_q, _ALIKE))})))), 6) as similarity, {_meaning('word_a', 'word_b')} as same_meaning from w"""

_VALUES = {**L.UNITS, **L.TENS, **L.COMPOUNDS}
_IDIOM = "|".join(p.replace(r"\w", r"[\pL\pN_]") for p in L.IDIOMS)


def _numbers(source: str) -> str:
    """Tables up to ``norm`` (id, t, normalized) of ``source`` (id, t)."""
    strip = _q("।,.")
    return f"""nt as (select id, t, {_tok('t')} as w from {source}),
nw as (select id, unnest(range(1, len(w) + 1)) as k, unnest(w) as word from nt),
nk as (select *, {_map(_VALUES)}[trim(word, {strip})] as v, {_map(L.MULTIPLIERS)}[trim(word, {strip})] as m from nw),
ni as (select *, v is not null or m is not null as known, k - row_number() over (partition by id, v is not null or m is not null order by k) as island from nk),
nr as (select id, min(k) as s, max(k) as e, string_agg(word, ' ' order by k) as span,
list_reduce(list_prepend({{'t': 0::hugeint, 'c': 0::hugeint}}, list({{'t': v::hugeint, 'c': m::hugeint}} order by k)), lambda a, x: case when x.t is not null then {{'t': a.t, 'c': a.c + x.t}}
when x.c >= 1000 then {{'t': a.t + case when a.c = 0 then 1 else a.c end * x.c, 'c': 0::hugeint}} else {{'t': a.t, 'c': case when a.c = 0 then 1 else a.c end * x.c}} end) as z from ni where known group by id, island),
np as (select nr.*, z.t + z.c as value, instr(t, span) - 1 as place, t from nr join nt using (id) where z.t + z.c > 0),
nd as (select * from np where place < 0 or not regexp_matches(substr(t, greatest(place - 20, 0) + 1, place + length(span) + 30 - greatest(place - 20, 0)), {_q(_IDIOM)})),
nj as (select nw.id, string_agg(case when nd.s is null then word else cast(value as varchar) end, ' ' order by k) filter (nd.s is null or nd.s = k) as joined from nw left join nd on nd.id = nw.id and k between s and e group by nw.id),
norm as (select nt.id, t, case when nt.id in (select id from np) then coalesce(joined, '') else t end as normalized from nt left join nj using (id))"""


NUMBERS = f"with {_U}, src as (select utt_id as id, reference as t from utterances), {_numbers('src')} select id as utt_id, normalized from norm"

_PUNCT = _q(text._PUNCT)


def _method(core: str) -> str:
    suffix = f"regexp_matches({core}, '^[\\pL\\pN_]+({'|'.join(L.LOAN_SUFFIXES)})$') and {core} not in ({', '.join(map(_q, L.SUFFIX_EXCEPTIONS))})"
    return f"case when {core} = '' then null when {_map(L.LOANS)}[{core}] is not null then 'dictionary' when {suffix} then 'suffix_pattern' when regexp_matches({core}, '{_ROMAN}') then 'roman_script' end"


def _loans(source: str) -> str:
    """Tables up to ``loans`` (id, word, english_equivalent, method, position) of ``source`` (id, t)."""
    return f"""lt as (select id, {_tok('t')} as w from {source}), lw as (select id, unnest(range(0, len(w))) as position, trim(unnest(w), {_PUNCT}) as word from lt), lm as (select *, {_method('word')} as method from lw),
loans as (select id, word, case method when 'dictionary' then {_map(L.LOANS)}[word] when 'roman_script' then word end as english_equivalent, method, position from lm where method is not null)"""


LOANS = f"with {_U}, src as (select utt_id as id, reference as t from utterances), {_loans('src')} select id as utt_id, word, english_equivalent, method, position from loans"
CLEANUP = f"""with {_U}, src as (select utt_id as id, reference as t from utterances), {_numbers('src')}, after as (select id, normalized as t from norm), {_loans('after')},
per as (select n.id, n.t <> n.normalized or count(l.word) > 0 as changed, count(l.word) as words from norm n left join loans l using (id) group by n.id, n.t, n.normalized)
select count(*) as transcripts, count(*) as logged, count(*) filter (changed) as changed, cast(sum(words) as bigint) as english_words, (select count(distinct word) from loans) as unique_english from per"""


def _once(w: str) -> str:
    return f"list_filter({w}, lambda t, i: i = 1 or t <> {w}[i - 1])"


def _ngrams(w: str, n: int) -> str:
    return f"""list_reduce(list_prepend([]::varchar[], list_transform({w}, lambda x: [x])), lambda acc, x: case when len(acc) + 1 >= {2 * n} and list_concat(acc, x)[len(acc) + 2 - {n}:len(acc) + 1] = list_concat(acc, x)[len(acc) + 2 - {2 * n}:len(acc) + 1 - {n}]
then list_concat(acc, x)[1:len(acc) + 1 - {n}] else list_concat(acc, x) end)"""


def _suppressed(source: str) -> str:
    """Tables up to ``supp`` (id, t, fixed) of ``source`` (id, t)."""
    meant = " or ".join(f"contains(t, {_q(p)})" for p in L.INTENDED)
    return f"""s0 as (select id, t, {_tok('t')} as w from {source}), s1 as (select *, {_once('w')} as a from s0), s2 as (select *, {_ngrams('a', 2)} as b from s1), s3 as (select *, {_ngrams('b', 3)} as c from s2),
supp as (select id, t, case when {meant} or len(w) <= 1 then t else array_to_string(c, ' ') end as fixed from s3)"""


NGRAMS = f"with {_U}, src as (select conv_id || '-' || turn as id, text as t from conversations union all select utt_id || '-' || model_id, prediction from pairs), {_suppressed('src')} select id, fixed from supp"


def _normal(t: str) -> str:
    out = f"trim(regexp_replace(regexp_replace(replace(translate({t}, chr(8203) || chr(8204) || chr(8205), ''), '|', '।'), '\\.{{2,}}', '।', 'g'), '{_BLANK}', ' ', 'g'), ' ।,.')"
    for a, b in L.VARIANTS.items():
        out = f"replace({out}, {_q(a)}, {_q(b)})"
    return f"trim({out})"


_FREQ = _map({w: i + 1 for i, w in enumerate(dict.fromkeys(WORDS))})
_TRIES = "[" + ", ".join(f"case when contains(word, {_q(a)}) then substr(word, 1, instr(word, {_q(a)}) - 1) || {_q(b)} || substr(word, instr(word, {_q(a)}) + {len(a)}) end" for a, b in map(tuple, L.CONFUSABLE)) + "]"


def _resolved(source: str, column: str) -> str:
    """Tables up to ``res`` (id, fixed) of ``source`` (id, column)."""
    return f"""cw as (select id, unnest(range(1, len(w) + 1)) as k, unnest(w) as word from (select id, {_tok(column)} as w from {source})),
ct as (select *, list_transform(list_filter({_TRIES}, lambda c: c is not null), lambda c: {{'n': coalesce({_FREQ}[c], 0), 'w': c}}) as tries from cw),
cb as (select id, k, case when {_FREQ}[word] is not null or len(tries) = 0 or list_max(list_transform(tries, lambda x: x.n)) = 0 then word
else list_filter(tries, lambda x: x.n = list_max(list_transform(tries, lambda y: y.n)))[1].w end as best from ct),
res as (select s.id, coalesce(string_agg(best, ' ' order by k), '') as fixed from {source} s left join cb using (id) group by s.id)"""


CONFUSIONS = f"with {_U}, src as (select utt_id || '-' || model_id as id, prediction as t from pairs), {_resolved('src', 't')} select id, fixed as resolved from res"
FIX_EVAL = f"""with recursive {_U}, ids as (select row_number() over (order by utt_id, model_id) as id, model_id, {_normal('reference')} as r, {_normal('prediction')} as o from pairs),
src as (select id, o as t from ids), {_suppressed('src')}, {_resolved('supp', 'fixed')},
one as (select id * 2 as id, {_tok('r')} as r, {_tok('o')} as h from ids union all select id * 2 + 1, {_tok('r')}, {_tok('fixed')} from ids join res using (id)),
{_paths('ed', 'one')}, w as (select id // 2 as id, max(case when id % 2 = 0 then case when len(r) > 0 then c / len(r) else 0 end end) as a, max(case when id % 2 = 1 then case when len(r) > 0 then c / len(r) else 0 end end) as b from ed group by 1)
select model_id, count(*) filter (b < a) as improved, count(*) filter (b = a) as unchanged, count(*) filter (b > a) as degraded from w join ids using (id) group by model_id"""


def _labels() -> str:
    numbers = _list(L.ERROR_NUMBERS)
    has = lambda w, t: f"(list_has_any({w}, {numbers}) or regexp_matches({t}, '[\\p{{Nd}}²³¹⁰⁴-⁹₀-₉]'))"
    filler = lambda a, b: "(" + " or ".join(f"(contains({a}, {_q(f)}) and not contains({b}, {_q(f)}))" for f in L.FILLERS) + ")"
    bag = lambda w: f"list_sort(list_distinct({w}))"
    bare = lambda t: _tok(f"regexp_replace({t}, '[।,.!?\\-]', '', 'g')")
    rn, pn = has("r", "reference"), has("h", "prediction")
    close = f"len(list_filter(range(1, len(r) + 1), lambda i: r[i] <> h[i] and {_chars_apart('r[i]', 'h[i]')} <= 2)) > 0"
    again = "len(list_filter(range(1, len(h)), lambda i: h[i] = h[i + 1] and (i >= len(r) or r[i] <> r[i + 1]))) > 0"
    rules = [
        ("regexp_matches(reference || ' ' || prediction, '[a-zA-Z]')", "code_mixing"),
        (f"({rn} or {pn}) and ({rn} <> {pn} or {bag('r')} <> {bag('h')})", "number_error"),
        (filler("prediction", "reference"), "disfluency_insertion"),
        (filler("reference", "prediction"), "disfluency_deletion"),
        (f"len(r) = len(h) and {close}", "phonetic_confusion"),
        (again, "repetition_error"),
        ("len(h) > len(r) * 1.3", "insertion_error"),
        ("len(h) < len(r) * 0.7", "deletion_error"),
        (f"{bare('reference')} = {bare('prediction')} and reference <> prediction", "punctuation_only"),
        ("(" + " or ".join(f"contains(reference, {_q(c)}) <> contains(prediction, {_q(c)})" for c in L.CONJUNCTS) + ")", "conjunct_consonant_error"),
    ]
    found = "list_filter([" + ", ".join(f"case when {c} then '{name}' end" for c, name in rules) + "], lambda x: x is not null)"
    return f"""toks as (select *, {_tok('reference')} as r, {_tok('prediction')} as h from pairs), lab as (select utt_id, model_id, reference, prediction, {found} as l from toks),
labelled as (select utt_id, model_id, reference, prediction, case when len(l) = 0 and reference <> prediction then ['general_substitution'] else l end as labels from lab)"""


LABELS = f"with {_U}, {_labels()} select utt_id, model_id, array_to_string(labels, '|') as labels from labelled"
TAXONOMY = f"""with {_U}, {_labels()}, each as (select utt_id, model_id, prediction, unnest(labels) as category from labelled where reference <> prediction),
f as (select *, row_number() over (partition by category order by utt_id, model_id) as i from each)
select category, count(*) as errors, string_agg(prediction, '|' order by i) filter (i <= 5) as examples from f group by category order by errors desc, category limit 3"""


def _classified(word: str, freq: str, total: str) -> str:
    """A struct (classification, confidence, reason) of a word."""
    clean = f"trim({word}, {_q(text.DANDA + ',.!?()[]{}' + chr(34) + chr(39) + ' ')})"
    bad = f"regexp_extract({clean}, '[^\\x{{0900}}-\\x{{097F}}\\p{{Nd}}\\-]')"
    much = f"list_filter(string_split({clean}, ''), lambda c: regexp_matches(c, '[\\x{{0900}}-\\x{{097F}}]') and length({clean}) - length(replace({clean}, c, '')) > 4)[1]"
    out = lambda c, f, r: f"{{'classification': '{c}', 'confidence': '{f}', 'reason': {r}}}"
    counted = lambda t: f"'{t} (freq=' || {freq} || ')'"
    return (
        f"case when {clean} = '' then {out('incorrect', 'high', _q('empty or punctuation-only'))} when {clean} in ({', '.join(map(_q, L.STOPWORDS))}) then {out('correct', 'high', _q('in known Hindi dictionary/stopwords'))} "
        f"when {clean} in ({', '.join(map(_q, L.VALID_LOANS))}) then {out('correct', 'high', _q('valid English word in Devanagari (per transcription guidelines)'))} "
        f"when {bad} <> '' then {out('incorrect', 'high', f'''{_q("invalid characters: non-Devanagari character: '")} || {bad} || {_q("' (U+")} || lpad(upper(format('{{:x}}', unicode({bad}))), 4, '0') || ')' ''')} "
        f"when regexp_matches({clean}, '[\\x{{093E}}-\\x{{094D}}]{{3,}}') then {out('incorrect', 'high', _q('multiple consecutive matras/halants'))} when regexp_matches({clean}, '^[\\x{{093E}}-\\x{{094D}}]') then {out('incorrect', 'high', _q('starts with matra/halant'))} "
        f"when length({clean}) between 2 and 15 and {much} is not null then {out('incorrect', 'medium', f'''{_q("character '")} || {much} || {_q("' repeated excessively")}''')} "
        f"when {freq} > 0 and {freq} / {total} > 0.0001 then {out('correct', 'high', counted('high frequency word'))} when {freq} > 0 and {freq} / {total} > 0.00001 then {out('correct', 'medium', counted('moderate frequency word'))} "
        f"when {freq} > 0 then {out('correct', 'low', counted('rare word - may be valid but uncommon'))} "
        f"when ({' or '.join(f'ends_with({clean}, {_q(s)})' for s in L.VALID_SUFFIXES)}) and length({clean}) > 3 then {out('correct', 'medium', _q('has valid Hindi suffix pattern'))} "
        f"when not ends_with({clean}, '्') then {out('correct', 'low', _q('valid characters but not in dictionary - may be proper noun, dialectal, or uncommon word'))} else {out('incorrect', 'low', _q('not in dictionary and has suspicious patterns'))} end"
    )


_CLASSED = f"""with {_U}, words as (select unnest({_tok('text')}) as word from conversations union all select unnest({_tok('reference')}) from utterances),
freqs as (select word, count(*) as freq, sum(count(*)) over () as total from words group by word), classed as (select word, {_classified('word', 'freq', 'total')} as c from freqs) """
CLASSIFY = _CLASSED + "select word, c.classification as classification, c.confidence as confidence, c.reason as reason from classed"
CLASS_SUMMARY = _CLASSED + "select c.classification as classification, c.confidence as confidence, count(*) as words from classed group by 1, 2"

_CATEGORY = f"""case when contains(word, '-') then 'compound' when length(word) <= 2 then 'abbreviation'
when ({' or '.join(f'ends_with(word, {_q(s)})' for s in L.CATEGORY_SUFFIXES)}) and length(word) > 4 then 'english_transliteration'
when word in ({', '.join(map(_q, L.INTERJECTIONS))}) or (length(word) >= 4 and substr(word, 1, length(word) // 2) = substr(word, length(word) // 2 + 1)) then 'onomatopoeia' else 'standard_hindi' end"""
_PAIRS = "len(list_filter(range(1, length(word)), lambda i: word[i] = '्' and word[i + 1] = '्'))"
_NOTES = f"""case category when 'compound' then 'Compound word with ' || len(string_split(word, '-')) || ' parts: [''' || array_to_string(string_split(word, '-'), ''', ''') || ''']; Check if both parts are valid Hindi words'
{' '.join(f"when {_q(k)} then {_q(v)}" for k, v in L.NOTES.items())} else case when {_PAIRS} > 0 then array_to_string(list_transform(range({_PAIRS}), lambda _: {_q(L.DOUBLE_HALANT)}), '; ') else {_q(L.STANDARD_NOTE)} end end"""
_REVIEW = f"""with lw as (select distinct regexp_replace(unnest({_tok('text')}), '[A-Za-z]+', 'कख', 'g') as word from conversations),
lc as (select word, {_classified('word', '0', '1')} as c from lw), ll as (select word, c, row_number() over (order by md5(word)) - 1 as i, count(*) over () as n from lc where c.confidence = 'low'),
lk as (select *, {_CATEGORY} as category, greatest(1, n // least(50, n)) as step from ll),
review as (select md5(word) as pos, word, c.classification as system_classification, c.reason as system_reason, category as word_category, {_NOTES} as analysis from lk where i % step = 0 and i / step < 50) """
REVIEW = _REVIEW + "select word, system_classification, system_reason, word_category, analysis from review"
UNRELIABLE = _REVIEW + f""", fit as (select *, case when system_classification = 'correct' then contains(lower(analysis), 'valid') or contains(lower(analysis), 'correct') else contains(lower(analysis), 'typo') or contains(lower(analysis), 'incorrect') end as fits,
row_number() over (partition by word_category order by pos) as i from review),
cats as (select word_category as category, count(*) as total_words, count(*) filter (not fits) as system_errors, string_agg(word, '|' order by i) filter (i <= 5) as examples from fit group by 1)
select category, total_words, system_errors, printf('%.1f%%', system_errors / total_words * 100) as error_rate, examples, coalesce({_map(L.REASONS)}[category], 'The system has limited coverage for ' || category || ' words.') as reason from cats where total_words >= 2 and system_errors / total_words > 0.3"""

_PROPOSED = f"coalesce({_map({k: v[0] for k, v in L.PROPOSALS.items()})}[category], 'Fix for ' || category) as fix_title, coalesce({_map({k: v[1] for k, v in L.PROPOSALS.items()})}[category], 'Custom fix needed') as implementation"
PROPOSALS = f"select category, errors, {_PROPOSED}, examples from ({TAXONOMY})"

SQL = {
    "fix_proposals": PROPOSALS,
    "low_conf_review": REVIEW,
    "unreliable_categories": UNRELIABLE,
    "repetition_ngrams": NGRAMS,
    "edit_ops_counts": EDIT_OPS,
    "error_labels": LABELS,
    "taxonomy_topk": TAXONOMY,
    "number_normalize": NUMBERS,
    "loan_detect": LOANS,
    "cleanup_summary": CLEANUP,
    "confusion_resolve": CONFUSIONS,
    "fix_eval": FIX_EVAL,
    "spell_classify": CLASSIFY,
    "spell_summary": CLASS_SUMMARY,
    "align_matrix": ALIGN_MATRIX,
    "lattice_bins": LATTICE_BINS,
    "lattice_wer": LATTICE_WER,
    "model_summary": MODEL_SUMMARY,
    "phonetic_pairs": PHONETIC,
}
