"""DuckDB SQL that gives the rows of registered corpus queries."""

from __future__ import annotations

from oddsframe.llm import urlfilter
from oddsframe.llm.sharding import BLOCK_DIGITS, ROUNDS

CRC = """crc as (
  select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) t)"""  # table t of the checksum, entry by byte


def _digits(text: str, n: int) -> str:
    return f"('0x' || substr(md5({text}), 1, {n}))::bigint"


def _pass(source: str, seed: int, keep: str) -> str:
    """One pass of the network over column v of `source`, which also has a, b and n."""
    out = f"select {keep}, a, b, n, v // b l, v % b r from {source}"
    for k in range(ROUNDS):
        if k % 2 == 0:
            out = f"select {keep}, a, b, n, (l + {_digits(f"'{seed}:{k}:' || r", 15)} % a) % a l, r from ({out})"
        else:
            out = f"select {keep}, a, b, n, l, (r + {_digits(f"'{seed}:{k}:' || l", 15)} % b) % b r from ({out})"
    return f"select {keep}, a, b, n, l * b + r v from ({out})"


def sharding(shards: int, seed: int) -> str:
    name = "concat_ws(':', coalesce(doc_id::varchar, '-'), text_crc32, size)"
    cols = "doc_id, size, text_crc32, number"
    return f"""
with recursive {CRC},
bytes as (select doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint) bytes from documents),
rows_ as (select doc_id, len(bytes) + 1 size,
  xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) text_crc32 from bytes, crc),
numbered as (select *, row_number() over (order by {_digits(name, BLOCK_DIGITS)}, doc_id nulls first, size, text_crc32) - 1 number, count(*) over () n from rows_),
sized as (select {cols}, n, number v, greatest(ceil(sqrt(n)), 1)::bigint a from numbered),
start as (select {cols}, n, v, a, (n + a - 1) // a b from sized),
walk as ({_pass("start", seed, cols)} union all {_pass("(select * from walk where v >= n)", seed, cols)})
select doc_id, size::bigint size, text_crc32::bigint text_crc32, 'rows' law, (v % {shards})::int shard, (v // {shards})::bigint slot, null::int grown_shard
from walk where v < n"""


def mixing(max_repeats: float, block_tokens: int, seed: int) -> str:
    perm = _digits(f"concat_ws(':', {seed}, epoch, item)", 15)
    return f"""
with recursive rows_ as (select doc_id, source, coalesce('s:' || source, 'none') name,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint tokens,
  {_digits("coalesce(doc_id::varchar, '-') || ':' || md5(coalesce(text, ''))", 15)} item, count(*) copies from documents group by all),
sources as (select name, sum(tokens * copies)::bigint all_tokens from rows_ group by name),
total as (select sum(all_tokens)::double tokens, max(all_tokens)::double largest, min(all_tokens)::double least from sources where all_tokens > 0),
halving as (select 0 k, 0.0::double lo, 1.0::double hi union all
  select k + 1, case when pow(largest / least, 1 - (lo + hi) / 2) <= {max_repeats} then lo else (lo + hi) / 2 end,
    case when pow(largest / least, 1 - (lo + hi) / 2) <= {max_repeats} then (lo + hi) / 2 else hi end from halving, total where k < 40),
chosen as (select ceil(hi * 1e9 - 1e-3) / 1e9 t from halving where k = 40),
norm as (select sum(pow(all_tokens / tokens, t)) z from sources, total, chosen where all_tokens > 0),
plan as (select name, all_tokens, case when all_tokens > 0 then floor(pow(all_tokens / tokens, t) / z
  * (largest / (pow(largest / tokens, t) / z)) + 0.5)::bigint else 0 end budget from sources, total, chosen, norm),
planned as (select *, case when all_tokens > 0 then budget // all_tokens else 1 end whole from plan),
blocks as (select greatest(1, ceil(sum(budget) / {float(block_tokens)}))::bigint blocks from plan),
emitted as (select r.*, p.* exclude (name), unnest(range(0, case when budget - whole * all_tokens > 0 then whole + 1 else whole end)) epoch
  from rows_ r join planned p using (name)),
placed as (select *, coalesce(sum(tokens * copies) over (partition by name, epoch order by {perm}, item, doc_id nulls first
  rows between unbounded preceding and 1 preceding), 0)::bigint start from emitted),
spelled as (select *, unnest(range(0, copies)) nth from placed where epoch < whole or start + tokens * copies <= budget - whole * all_tokens),
cut as (select *, case when budget > 0 then least(floor((epoch * all_tokens + start + nth * tokens)::double * blocks::double / budget::double), blocks - 1)::bigint else 0 end block
  from spelled, blocks)
select doc_id, source, tokens, epoch, block, {_digits(f"concat_ws(':', '{seed}b', block, epoch, item)", 15)} place from cut"""


def search(k: int, every: int) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
with words as (select doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+')) word from documents),
bags as (select doc_id, word, count(*)::double tf from words group by all),
lengths as (select doc_id, sum(tf) len from bags group by 1),
stats as (select (select count(*) from documents)::double n, (select sum(len) from lengths) / (select count(*) from documents) mean),
df as (select word, count(*)::double df from bags group by 1),
scored as (select q.doc_id query_id, d.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * len / mean))), 4) score
  from bags q join bags d using (word) join df using (word) join lengths l on l.doc_id = d.doc_id, stats where q.doc_id % {every} = 0 group by 1, 2)
select query_id, (row_number() over (partition by query_id order by score desc, doc_id))::int rank, doc_id, score from scored
qualify row_number() over (partition by query_id order by score desc, doc_id) <= {k}"""


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def url_filter(rules: list[tuple[str, str]], limit: float, z: float) -> str:
    rows = ", ".join(f"('{v}', '{r.split('/', 1)[0]}', '{r[r.index('/'):]}', '{r}')" for v, r in rules)

    def rho(children: str, parent: str) -> str:
        chance = "(mean * (1 - mean))"
        sums = f"sum(pow(bad - n * mean, 2) - n * {chance}), sum(n * (n - 1) * {chance})"
        means = f"select {parent}, sum(bad) / sum(n) mean from {children} group by 1"
        return f"""(select least(greatest(case when d > 0 then round(s / d, 6) else {urlfilter.MOST_RHO} end, {urlfilter.LEAST_RHO}), {urlfilter.MOST_RHO})::double rho
    from (select * from (select {sums} from {children} join ({means}) using ({parent}) where n > 1) t(s, d)))"""

    def summed(children: str, keys: str) -> str:
        worth = "case when n > 1 then n / (1 + (n - 1) * rho) else n end::double"
        return f"select {keys}, sum({worth}) n, sum(case when n > 0 then bad / n else 0 end * ({worth})) bad from {children}, {children}_rho group by all"

    def shrunk(children: str, table: str) -> str:
        return f"(select c.*, bad + (1 / rho - 1) * mean a, n - bad + (1 / rho - 1) - (1 / rho - 1) * mean b from {children} c, {table}_rho)"

    return f"""
with rules(verdict, host, path, rule) as (values {rows}),
urls as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end rest from pages),
cut as (select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{urlfilter.UPPER}', '{urlfilter.LOWER}'), '') host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') path from urls),
known as (select doc_id number, max(greatest((toxic = 1)::int, (quality = 0)::int)) bad from labels where doc_id is not null group by 1),
counts as (select host, count(k.bad) n, coalesce(sum(k.bad), 0)::bigint bad from cut c
  left join known k on k.number = try_cast(regexp_extract(path, '([0-9]{{1,18}})[^0-9]*$', 1) as bigint) group by 1),
names as (select *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') labels from counts),
sized as (select *, regexp_matches(array_to_string(labels, '.'), '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$') address,
  case when len(labels) > 2 and length(labels[-1]) = 2 and labels[-2] in ({_quoted(urlfilter.SECOND_LEVEL)}) then 2 else 1 end last from names),
hosts as (select host, n, bad, case when address then '' else array_to_string(labels[len(labels) - last + 1:], '.') end suffix,
  case when address or len(labels) <= last then array_to_string(labels, '.') else array_to_string(labels[len(labels) - last:], '.') end domain from sized),
hosts_rho as {rho("hosts", "domain")}, domains as ({summed("hosts", "domain, suffix")}),
domains_rho as {rho("domains", "suffix")}, suffixes as ({summed("domains", "suffix, '' whole")}),
suffixes_rho as {rho("suffixes", "whole")},
top as (select *, ((select sum(bad) from suffixes) + 0.5::double) / ((select sum(n) from suffixes) + 1.0::double) mean from suffixes),
suffix_means as (select suffix, a / (a + b) mean from {shrunk("top", "suffixes")}),
middle as (select d.*, mean from domains d join suffix_means using (suffix)),
domain_means as (select domain, a / (a + b) mean from {shrunk("middle", "domains")}),
low as (select h.*, mean from hosts h join domain_means using (domain)),
judged as (select host, a / (a + b) bad_share, {urlfilter.lower_bound(z)} bad_bound from {shrunk("low", "hosts")}),
fits as (select page_id, c.host, c.path, r.rule, r.verdict from cut c left join rules r
  on (c.host = r.host or ends_with(c.host, '.' || r.host)) and starts_with(c.path, r.path)
  qualify row_number() over (partition by page_id order by length(rule) desc, length(r.host) desc) = 1)
select page_id, host, path, rule, coalesce(verdict, case when bad_bound >= {limit} then 'block' else 'allow' end) verdict,
  round(bad_share, 6) bad_share, round(bad_bound, 6) bad_bound from fits join judged using (host)"""


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::varchar))::varchar || ':' || {value}::varchar, '-')"


def _raised(source: str) -> str:
    """Levels of the binary trees over `source` (tree, position, node, nodes), by recursion."""
    return f"""select tree, 0 level, position, node, nodes from {source} union all
  select tree, level + 1, position // 2, sha256(string_agg(node, '' order by position)), (any_value(nodes) + 1) // 2
  from {{}} where nodes > 1 group by tree, level, position // 2"""


def merkle() -> str:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    plain, other = (" || ".join(_field(f"({c} + {k})" if c == "n_chars" else c) for c in fields) for k in (0, 1))
    step = """select {who}, {base} + u.level step, case when x.position >> u.level & 1 = 1 then s.node else '' end l,
    case when x.position >> u.level & 1 = 0 then coalesce(s.node, '') else '' end r
  from {rows} x join (select distinct tree, level from {up} where nodes > 1) u on u.tree = {tree}
  left join {up} s on s.tree = u.tree and s.level = u.level and s.position = xor(x.position >> u.level, 1)"""
    return f"""
with recursive {CRC},
sums as (select doc_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(doc_id::varchar)), '..'),
  lambda x: ('0x' || x)::bigint)), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) crc from documents, crc),
rows_ as (select d.doc_id, coalesce('s:' || lang, 'none') tree, sha256({plain}) node, case when crc % 7 = 0 and n_chars is not null then sha256({other}) end claimed
  from documents d left join sums using (doc_id)),
leaves as (select *, row_number() over (partition by tree order by doc_id nulls first, node) - 1 position, count(*) over (partition by tree) nodes,
  row_number() over () item from rows_),
up as ({_raised("leaves").format("up")}),
subroots as (select tree lang, node subroot, '' tree, node, row_number() over (order by tree) - 1 position, count(*) over () nodes from up where nodes = 1),
top as ({_raised("subroots").format("top")}),
way as ({step.format(who="x.item", base=0, rows="leaves", up="up", tree="x.tree")} union all
  {step.format(who="x.item", base=1000, rows="(select item, g.position from leaves l join subroots g on g.lang = l.tree)", up="top", tree="''")}),
steps as (select item, l, r, row_number() over (partition by item order by step) k from way),
proofs as (select item, sha256(string_agg(l || r, '' order by k)) proof_sha256, max(k) ks from steps group by item),
fold as (select item, 0::bigint k, coalesce(claimed, node) h from leaves union all
  select item, s.k, sha256(l || h || r) from fold f join steps s using (item) where s.k = f.k + 1)
select doc_id, l.node leaf, subroot, root, coalesce(proof_sha256, sha256('')) proof_sha256, h folded_root, h = root verified
from leaves l join subroots g on g.lang = l.tree left join proofs using (item) join fold using (item),
  (select node root from top where nodes = 1) where fold.k = coalesce(ks, 0)"""
