"""DuckDB SQL for the queries that SQL can express, written from the contracts and not from the DataFrame code."""

from __future__ import annotations

from . import adaptive_rules, collocations, host_reputation, interval_overlap, merkle, secrets_index

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _quoted(regex: str) -> str:
    return regex.replace("'", "''")


def secrets() -> str:
    rules = secrets_index.RULES
    parts = []
    for k, r in enumerate(rules):
        regex = _quoted(r.regex)
        parts.append(
            f"""select doc_id, {k} as kind, '{r.kind}' as name, i - 1 as i, length(m[i]) as size, length(p[i]) as part,
                list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as start
            from (select doc_id, regexp_extract_all(t, '{regex}') as m, regexp_extract_all(t, '{regex}', {r.part}) as p, string_split_regex(t, '{regex}') as g
                  from (select doc_id, coalesce(text, '') as t from documents)), unnest(range(1, len(m) + 1)) as u(i)
            where length(p[i]) >= {r.least}"""
        )
    n = len(secrets_index.BASE)
    counts = ", ".join(f"coalesce(c.n_{r.kind}, 0)::bigint as n_{r.kind}" for r in secrets_index.BASE)
    sums = ", ".join(f"count(*) filter (kind = {k}) as n_{r.kind}" for k, r in enumerate(secrets_index.BASE))
    return f"""
    with found as ({' union all '.join(parts)}),
    spans as (select doc_id, kind, start::bigint as start, name || ':' || start::bigint || ':' || (start + size)::bigint as span from found),
    c as (select doc_id, {sums},
        string_agg(span, ',' order by start, kind) filter (kind < {n}) as base, string_agg(span, ',' order by start, kind) as spans
        from spans group by doc_id)
    select d.doc_id, {counts}, sha256(coalesce(c.base, '')) as base_sha256, coalesce(c.spans, '') as spans
    from documents d left join c on c.doc_id = d.doc_id"""


def fingerprints() -> str:
    pieces = _quoted(merkle.PIECES)

    def tree(text: str) -> str:
        leaves = f"list_transform(string_split({text}, chr(10)), lambda line: array_to_string(list_transform(regexp_extract_all(line, '{pieces}'), lambda p: left(sha256(p), 16)), ','))"
        return f"list_transform(range(1, len({leaves}) + 1, {merkle.SECTION}), lambda k: {leaves}[k:k + {merkle.SECTION - 1}])"

    digest = "left(sha256(array_to_string(list_transform(s, lambda p: left(sha256(p), 16)), ',')), 16)"

    def print_(tree_: str) -> str:
        root = f"sha256(array_to_string(list_transform({tree_}, lambda s: {digest}), ','))"
        return f"{root} || '|' || array_to_string(list_transform({tree_}, lambda s: array_to_string(s, '/')), ';')"

    def leaves(print_: str) -> str:
        return f"list_distinct(list_filter(regexp_split_to_array(split_part({print_}, '|', 2), '[,/;]'), lambda x: x <> ''))"

    def near(a: str, b: str) -> str:
        x, y = leaves(a), leaves(b)
        return f"case when left({a}, 64) = left({b}, 64) then 1.0::double else least(2.0::double * len(list_intersect({x}, {y})) / greatest(len({x}) + len({y}), 1), 1 - 1 / (len({x}) + len({y}) + 1.0::double)) end"

    return f"""
    with a as (select doc_id, coalesce(text, '') as text from documents),
    b as (select doc_id, text, length(text) as n, coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id)) as next_text from a),
    c as (select *, left(text, n - n // 4) || left(next_text, n // 4) as edited from b),
    t as (select *, {tree('text')} as ta, {tree('edited')} as te from c),
    f as (select doc_id, n, edited, {print_('ta')} as fp, {print_('te')} as fe,
        list_filter(flatten(list_transform(range(1, len(ta) + 1), lambda k: list_transform(range(1, len(ta[k]) + 1), lambda i: case when ta[k][i] is distinct from te[k][i] then (k - 1) || ':' || (i - 1) end))), lambda x: x is not null)[1] as edited_at from t),
    g as (select *, coalesce(lead(fp) over (order by doc_id), first_value(fp) over (order by doc_id)) as fn from f)
    select doc_id, n::bigint as n_chars, sha256(edited) as edited_sha256, fp as fingerprint, fe as edited_fingerprint,
        {near('fp', 'fe')} as near_edited, {near('fp', 'fn')} as near_next, edited_at from g"""


def rules() -> str:
    w, rules_, prior = adaptive_rules.WINDOW, adaptive_rules.RULES, adaptive_rules.PRIOR
    drop = "greatest(length(bin({0})) - " + str(adaptive_rules.BITS) + ", 0)::int"
    percent = "case measure " + " ".join(f"when '{k}' then {r.percent}" for k, r in rules_.items()) + " end"
    rates = ", ".join(f"{r.scale} * {r.count} // greatest({r.per}, 1) as m_{k}" for k, r in rules_.items())
    verdict = " and ".join(f"coalesce({r.inside.format(bound=f'b.b_{k}')}, true)" for k, r in rules_.items())

    lower = ", ".join(f"'{k}'" for k, r in rules_.items() if r.percent < 50)

    def quantiles(by: str) -> str:
        """Quantiles of sk's sketches, merged by the columns."""
        return f"""select {by} measure, max(n) as n, max(some_) as some_,
            min(case when p < 50 or bucket = 0 then bucket else bucket + (1::bigint << {drop.format("bucket")}) - 1 end) filter (100 * upto >= p * n) as edge,
            coalesce(min(bucket) filter (bucket > 0 and 100 * (upto - n + some_) >= {adaptive_rules.LOW} * some_), 0) as low
            from (select *, {percent} as p, sum(c) over (partition by {by} measure)::bigint as n, sum(c) over (partition by {by} measure order by bucket)::bigint as upto,
                      coalesce(sum(c) filter (bucket > 0) over (partition by {by} measure), 0)::bigint as some_
                  from (select {by} measure, bucket, sum(c) as c from sk group by all)) group by all"""

    def weighed(n: str, value: str, before: str) -> str:
        return f"(({n} * {value} + {prior} * {before}) // ({n} + {prior}))"

    edge = weighed("own.n", "own.edge", weighed("wide.n", "wide.edge", "whole.edge"))
    low = weighed("own.some_", "own.low", weighed("wide.some_", "wide.low", weighed("whole.some_", "whole.low", "0")))
    return f"""
    with d as (select doc_id, coalesce(text, '') as text, coalesce(lang, chr(1)) as lang, coalesce(source, chr(1)) as source, {_WORDS} as words from documents),
    grams as (select doc_id, unnest(range(1, len(words) - {w - 2})) as i, words from d where len(words) > {w}),
    twice as (select doc_id, i, count(*) over (partition by doc_id, array_to_string(words[i:i + {w - 1}], ' ')) as times from grams),
    covered as (select doc_id, count(distinct i + o) as n from twice, unnest(range(0, {w})) as u(o) where times > 1 group by doc_id),
    lined as (select *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from d),
    base as (select d.doc_id, lang, source, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
        len(lines) as n_lines, coalesce(c.n, 0)::bigint as n_repeat_words from lined d left join covered c on c.doc_id = d.doc_id),
    m as (select *, n_words < {adaptive_rules.LEAST_WORDS} or 100 * n_repeat_words > {adaptive_rules.REPEAT_PERCENT} * n_words as base_failed, {rates} from base),
    vals as (select lang, source, unnest({list(rules_)}) as measure, unnest([{', '.join(f'm_{k}' for k in rules_)}]) as value from m where not base_failed),
    sk as (select lang, source, measure, (value >> {drop.format("value")}) << {drop.format("value")} as bucket, count(*) as c from vals group by all),
    own as ({quantiles("lang, source,")}), wide as ({quantiles("lang,")}), whole as ({quantiles("")}),
    each as (select own.lang, own.source, own.measure, case when own.measure in ({lower}) then {edge} else greatest({edge}, {low}) end as bound
        from own join wide on own.lang = wide.lang and own.measure = wide.measure join whole on own.measure = whole.measure),
    b as (select lang, source, {', '.join(f"max(bound) filter (measure = '{k}') as b_{k}" for k in rules_)} from each group by all)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {verdict} as kept
    from m left join b on b.lang = m.lang and b.source = m.source"""


def phrases() -> str:
    c = collocations
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    grams = " union all ".join(f"select lang, list_transform(range(1, len(w) - {k - 2}), lambda i: w[i:i + {k - 1}]) as g from p where len(w) >= {k}" for k in range(1, c.LONGEST + 1))
    return f"""
    with p as (select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') as w
        from (select coalesce(lang, 'und') as lang, unnest(string_split_regex({lower}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents)),
    f as (select lang, g, count(*) as f from (select lang, unnest(g) as g from ({grams})) group by all),
    total as (select lang, sum(f) as n from f where len(g) = 1 group by lang),
    cand as (select lang, g, f as a from f where len(g) > 1 and f >= {c.LEAST}),
    longer as (select lang, g[i:j] as g, max(a) as most from (select lang, g, a, unnest(range(1, len(g))) as i from cand), unnest(range(i + 1, i + 5)) as u(j)
        where j <= len(g) and j - i + 1 < len(g) group by all),
    kept as (select c.lang, c.g, c.a from cand c left join longer x on x.lang = c.lang and x.g = c.g where x.most is null or 100 * x.most < {c.PERCENT} * c.a),
    cuts as (select k.lang, k.g, k.a, i, l.f as l, r.f as r, n, (1000::hugeint * k.a * n::hugeint) // (l.f::hugeint * r.f) as score
        from (select *, unnest(range(1, len(g))) as i from kept) k join f l on l.lang = k.lang and l.g = k.g[1:i] join f r on r.lang = k.lang and r.g = k.g[i + 1:] join total on total.lang = k.lang),
    best as (select *, row_number() over (partition by lang, g order by score, i) as no from cuts),
    ranked as (select *, array_to_string(g, ' ') as phrase, row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank from best where no = 1)
    select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked where rank <= {c.TOP}"""


def intervals() -> str:
    gap, slot = interval_overlap.GAP, interval_overlap.SLOT
    return f"""
    with c as (select client_id, epoch_us(ts) as m, coalesce(kind = 'error', false) as error from clicks where client_id is not null and ts is not null),
    g as (select *, case when m - lag(m) over w <= {gap} then 0 else 1 end as begins from c window w as (partition by client_id order by m)),
    h as (select *, sum(begins) over (partition by client_id order by m range unbounded preceding) as no from g),
    i as (select client_id, no, min(m) as first, max(m) as last from h group by all),
    session as (select i.client_id, i.first, i.first // {slot} as s2, case when exists (select 1 from h where h.client_id = i.client_id and h.no = i.no and h.m = i.last and h.error) then 9e18::bigint else i.last // {slot} end as e2 from i),
    ends as (select sale_id, max(shipped_at) as shipped from sale_lines where shipped_at is not null group by sale_id),
    sale as (select s.sale_id, s.client_id, epoch_us(sold_at) // {slot} as s1, case when coalesce(status = 'open', false) then 9e18::bigint else epoch_us(greatest(sold_at, coalesce(shipped, sold_at))) // {slot} end as e1
        from sales s left join ends on ends.sale_id = s.sale_id where client_id is not null and sold_at is not null),
    pairs as (select sale_id, s1, e1, s2, e2, first from sale join session on sale.client_id = session.client_id and s1 <= e2 and s2 <= e1)
    select sale_id,
        case when s1 < s2 then case when e1 < e2 then 'overlaps' when e1 = e2 then 'finished_by' else 'contains' end
             when s1 = s2 then case when e1 < e2 then 'starts' when e1 = e2 then 'equals' else 'started_by' end
             else case when e1 < e2 then 'during' when e1 = e2 then 'finishes' else 'overlapped_by' end end as relation,
        count(*) as n_pairs, sum(case when e1 = 9e18::bigint and e2 = e1 then null else least(e1, e2) - greatest(s1, s2) + 1 end)::bigint as overlap_slots,
        sum({_crc32("first::varchar")})::bigint as sessions_crc
    from pairs group by 1, 2"""


def _crc32(text: str) -> str:
    """crc32 of ASCII text, bit by bit; the polynomial is that of the usual checksum."""
    step = "case when d & 1 = 1 then xor(d >> 1, 3988292384::bigint) else d >> 1 end"
    byte = f"list_reduce(range(0, 8), lambda d, x: {step}, xor(c, b))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint), lambda c, b: {byte}, 4294967295::bigint), 4294967295::bigint)"


def urls() -> str:
    h = host_reputation
    ordered = sorted(h.RULES, key=lambda r: -len(r.host + r.path))
    fits = [f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then" for r in ordered]
    rule = " ".join(f"{x} '{r.host}{r.path}'" for x, r in zip(fits, ordered, strict=True))
    verdict = " ".join(f"{x} '{r.verdict}'" for x, r in zip(fits, ordered, strict=True))
    two = f"list_contains([{', '.join(repr(x) for x in h.SUFFIXES)}], array_to_string(l[-2:], '.'))"

    def level(rows: str, above: str, out: str) -> str:
        spread = f"n * {above} * (1 - {above})"
        r = f"(select case when sum({spread} * (n - 1)) > 0 then sum((good - n * {above}) ** 2 - {spread}) / sum({spread} * (n - 1)) else 0 end from {rows})"
        weight = f"(select case when r > 0 then least({h.WEIGHTS[1]}, greatest({h.WEIGHTS[0]}, 1 / r - 1)) else {h.WEIGHTS[1]} end from (select {r} as r))"
        return f"select *, (good + w * {above}) / (n + w) as {out} from (select *, {weight}::double as w from {rows})"

    return f"""
    with a as (select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
    p as (select page_id, url, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), '{h.UPPER}', '{h.LOWER}') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from a),
    seen as (select host, case when coalesce(quality, 1) = 1 and coalesce(toxic, 0) = 0 then 1 else 0 end as good
        from p join labels on doc_id = try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:[.][a-z]+)?/?$', 1) as bigint) where quality is not null or toxic is not null),
    host as (select host, sum(n) as n, sum(good) as good from (select host, 0 as n, 0 as good from p union all select host, 1, good from seen) group by host),
    named as (select host, n, good, string_split(host, '.') as l from host),
    parts as (select host, n, good, case when {two} then array_to_string(l[-2:], '.') else l[-1] end as suffix, case when {two} then array_to_string(l[-3:], '.') else array_to_string(l[-2:], '.') end as domain from named),
    s0 as (select suffix, sum(n) as n, sum(good) as good, (select (sum(good) + 1.0::double) / (sum(n) + 2) from parts) as above from parts group by suffix),
    s1 as ({level("s0", "above", "by_suffix")}),
    d0 as (select q.*, by_suffix from (select suffix, domain, sum(n) as n, sum(good) as good from parts group by all) q join s1 on s1.suffix = q.suffix),
    d1 as ({level("d0", "by_suffix", "by_domain")}),
    h0 as (select parts.*, by_domain from parts join d1 on d1.suffix = parts.suffix and d1.domain = parts.domain),
    h1 as ({level("h0", "by_domain", "rate")}),
    b as (select host, least(1.0, rate + {h.Z} * sqrt(rate * (1 - rate) / (n + w + 1))) as bound from h1)
    select page_id, host, path, case {rule} end as rule, coalesce(case {verdict} end, case when bound < {h.LEAST} then 'block' else 'allow' end) as verdict, round(bound, 6) as host_bound
    from p join b using (host)"""


ORACLE_SQL = {
    "op5_secrets": secrets(),
    "op7_merkle": fingerprints(),
    "op8_adaptive_rules": rules(),
    "op11_collocations": phrases(),
    "op12_interval_overlap": intervals(),
    "op13_host_reputation": urls(),
}
