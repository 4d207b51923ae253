"""SQL building blocks for the checks: the derived inputs and the text functions, in DuckDB's dialect.

Written independently of the Spark expressions; only the fixed values are shared.
"""

from __future__ import annotations

from ..functions import constants as K
from .inputs import ROLLOUTS, STEPS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WS_CLASS = K.WHITESPACE_CLASS
NUMBER = quoted(K.NUMBER.replace(r"\d", r"\p{Nd}"))
_DIGITS = r"\p{Nd}+(?:_\p{Nd}+)*"


def strip(x: str) -> str:
    return f"trim({x}, {quoted(K.WHITESPACE)})"


def last(x: str, pattern: str, group: int) -> str:
    return f"regexp_extract_all({x}, {pattern}, {group})[-1]"


def draw(seed: str, *keys: str) -> str:
    """Uniform in [0, 1) from a digest."""
    return hex_fraction(digest(seed, *keys), 1)


def digest(seed: str, *keys: str) -> str:
    return f"md5(concat_ws(':', {quoted(seed)}, {', '.join(f'cast({k} as varchar)' for k in keys)}))"


def hex_fraction(hexdigits: str, start: int) -> str:
    return f"(('0x' || substr({hexdigits}, {start}, 13))::bigint / 4503599627370496.0::double)"


def normal(seed: str, keys: list[str], position: str) -> str:
    """Element `position` (from 0) of the normal vector of a key."""
    d = digest(seed, *keys, f"({position}) // 2")
    radius = f"sqrt(-2.0::double * ln(1.0::double - {hex_fraction(d, 1)}))"
    angle = f"2.0::double * pi() * {hex_fraction(d, 14)}"
    return f"(case when ({position}) % 2 = 0 then {radius} * cos({angle}) else {radius} * sin({angle}) end)"


def micro(x: str) -> str:
    """A double array as text of millionths."""
    return f"array_to_string(list_transform({x}, lambda e: cast(round(e * 1e6) as bigint)), ',')"


def micro_scalar(x: str) -> str:
    return f"cast(round(({x}) * 1e6) as bigint)"


def joined(x: str, separator: str = ",") -> str:
    return f"array_to_string({x}, {quoted(separator)})"


# Text functions --------------------------------------------------------------


def clean_answer(x: str) -> str:
    inner = strip(f"trim({strip(x)}, '$')")
    return strip(f"trim({strip(f'ltrim({inner}, {quoted(chr(58))})')}, '$')")


def extract_answer(x: str) -> str:
    phrase = quoted("(?i)" + K.with_whitespace(K.ANSWER_PHRASE))
    found = f"coalesce({last(x, quoted(K.BOXED_NESTED), 1)}, {last(x, phrase, 1)})"
    return f"coalesce({clean_answer(found)}, '')"


def strip_latex(x: str) -> str:
    for token in K.LATEX_DELETED:
        x = f"replace({x}, {quoted(token)}, '')"
    x = f"regexp_replace({x}, {quoted(K.LATEX_UNWRAPPED)}, '\\1', 'g')"
    return f"regexp_replace({x}, {quoted(K.LATEX_FRACTION)}, '\\1/\\2', 'g')"


def _stages(source: str, keep: str, stages: list[tuple[str, str]]) -> str:
    """Nested SELECTs, one per stage, so that every intermediate is computed once."""
    sql = f"select {keep}, {stages[0][1]} as {stages[0][0]} from {source}"
    for name, expression in stages[1:]:
        sql = f"select *, {expression} as {name} from ({sql})"
    return sql


def _final_stages(text: str) -> list[tuple[str, str]]:
    conclusion = quoted("(?i)" + K.with_whitespace(K.CONCLUSION_PHRASE))
    equals = quoted("(?i)" + K.with_whitespace(K.TRAILING_EQUALS))
    return [
        ("plain", strip(strip_latex(text))),
        ("boxed", last("plain", quoted(K.BOXED_FLAT), 1)),
        ("marked", "case when contains(plain, '####') then regexp_extract(plain, '(?s)\\A(.*)####(.*)\\z', 2) end"),
        ("stated", f"coalesce({last('plain', conclusion, 1)}, {last('plain', equals, 1)})"),
        (
            "final",
            f"""case when plain = '' then null
            when boxed is not null then {strip('boxed')}
            when marked is not null then {strip('marked')}
            when stated is not null then coalesce({last(strip('stated'), NUMBER, 0)}, {strip('stated')})
            else coalesce({last('plain', NUMBER, 0)},
                          {strip(f"regexp_split_to_array(plain, {quoted(K.LINE_END)})[-1]")}) end""",
        ),
    ]


def _number_stages(x: str, prefix: str) -> list[tuple[str, str]]:
    digits, plain = prefix + "_digits", prefix + "_literal"
    fraction = quoted(rf"[-+]?{_DIGITS}{_WS_CLASS}*/{_WS_CLASS}*{_DIGITS}")
    real = quoted(rf"[-+]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][-+]?{_DIGITS})?")
    top, bottom = strip(f"split_part({plain}, '/', 1)"), strip(f"split_part({plain}, '/', 2)")
    return [
        (digits, strip(f"rtrim(replace({strip(x)}, ',', ''), '.')")),
        (plain, f"translate(replace({digits}, '_', ''), '{K.OTHER_DIGITS}', '{K.OTHER_DIGIT_VALUES}')"),
        (
            prefix + "_value",
            f"""case when regexp_full_match({digits}, {fraction})
            then try_cast({top} as double) / nullif(try_cast({bottom} as double), 0)
            when regexp_full_match({digits}, {real}) then try_cast({plain} as double) end""",
        ),
        (prefix, f"case when abs({prefix}_value) < 'infinity'::double then {prefix}_value end"),
    ]


def final_answer(source: str, text: str, keep: str = "*") -> str:
    """SELECT that appends `final` to the columns of a relation."""
    return _stages(source, keep, _final_stages(text))


def numbered(source: str, text: str, keep: str = "*") -> str:
    """SELECT that appends `number`."""
    return _stages(source, keep, _number_stages(text, "number"))


def normalized(source: str, text: str, keep: str = "*") -> str:
    """SELECT that appends `normal` and `normal_number`."""
    tidy = f"""trim(regexp_replace(replace(lower({strip(strip_latex('final'))}), ',', ''), {quoted(_WS_CLASS + '+')}, ' ', 'g'),
        {quoted(K.ANSWER_EDGE_CHARS)})"""
    normal = """case when abs(number - round_even(number, 0)) < 1e-9
        then case when abs(number) < 9e18 then cast(cast(round_even(number, 0) as bigint) as varchar)
                  else cast(cast(number as bignum) as varchar) end
        when number is not null then printf('%.10g', number)
        else tidy end"""
    stages = [
        *_final_stages(text),
        ("tidy", tidy),
        *_number_stages("tidy", "number"),
        ("normal", normal),
        *_number_stages("normal", "normal_number"),
    ]
    return _stages(source, keep, stages)


# Derived inputs --------------------------------------------------------------

QA = """
qa0 as (select o_orderkey as id, o_orderstatus as status, cast(floor(o_totalprice) as bigint) as c,
               1 + o_orderkey % 9 as k from orders),
qa as (select id, c * k as n,
        '  How many items has order ' || id || ' in status ' || status || '?' || chr(10) as question,
        array_to_string(list_transform(range(1, k + 1), lambda i:
            (case when i % 4 = 0 then '  ' || chr(10) else '' end)
            || '  Line ' || i || ': <<' || c || '*' || i || '=' || (c * i) || '>> items '), chr(10))
        || case when id % 11 = 0 then ''
                when id % 13 = 0 then ' #### 0' || chr(10) || 'Check' || chr(10) || '#### ' || shown
                when id % 17 = 0 then chr(10) || '##### ' || shown
                else chr(10) || '#### ' || shown || ' ' end as answer
       from (select *, case when id % 5 = 0 then format('{:,}', c * k) else cast(c * k as varchar) end as shown from qa0))
"""

RESPONSES = f"""{QA},
responses0 as (select id as example_id, r as rollout_id, question, n,
        case when {draw('r', 'id', 'r')} < 0.6 then n else n + 1 end as v
       from qa, (select unnest(range({ROLLOUTS})) as r)),
responses as (select example_id, rollout_id, question, cast(n as varchar) as target,
        case (example_id + rollout_id) % 7
          when 0 then 'Thus $\\boxed{{' || v || '}}$.'
          when 1 then 'So \\boxed{{\\frac{{' || (v * 2) || '}}{{2}}}}'
          when 2 then 'Adding up' || chr(10) || '#### ' || v
          when 3 then 'The answer is: $' || v || '$.' || chr(10) || 'Done'
          when 4 then 'total\\, = ' || v
          when 5 then 'I get ' || format('{{:,}}', v) || ' items' || chr(10)
          else 'no idea' end as final_text
       from responses0)
"""

TRAJECTORIES = f"""
grid as (select unnest(list_append(list_transform(range({STEPS}), lambda i: 999 * ({STEPS} - 1 - i) // ({STEPS} - 1)), 0)) as timestep,
                unnest(range({STEPS} + 1)) as step_id),
trajectories as (select o_orderkey as example_id, r as rollout_id, step_id, timestep,
        case when {draw('s', 'o_orderkey', 'r', 'step_id')} < 0.5 then 1.0::double else 0.0::double end as reward,
        embedding as latent
       from orders, (select unnest(range({ROLLOUTS})) as r), grid, (select count(*) as vectors from embeddings), embeddings
       where vec_id = (o_orderkey * 31 + r * 7 + step_id) % vectors)
"""

TEXTS = f"""{RESPONSES},
texts as (select 'r:' || example_id || ':' || rollout_id as text_id, final_text as text from responses
   union all select 'd:' || doc_id, text from documents
   union all select 'p:' || page_id, html from pages
   union all select 'b:' || item_id, text from benchmark
   union all select 'c:' || conv_id || ':' || turn, text from conversations)
"""

PAIRS = """
pairs as (select a.conv_id, a.turn, a.text as input, b.text as output
  from conversations a join conversations b on a.conv_id = b.conv_id and a.turn + 1 = b.turn
  where a.role = 'user' and b.role = 'assistant')
"""

TOKENS = rf"""
tokens as (select doc_id, list_transform(parts, lambda w: ('0x' || substr(md5(w), 1, 7))::bigint % 30000 + 10) as ids
  from (select doc_id, list_filter(regexp_split_to_array(text, {quoted(_WS_CLASS + '+')}), lambda w: w <> '') as parts
        from documents) where len(parts) > 0)
"""

SCORED = """
scored as (select d.doc_id, (d.n_chars % 2001 - 1000) / 250.0::double as logit, l.quality::double as label
  from documents d join labels l on d.doc_id = l.doc_id)
"""

GAUSSIANS = """
gaussians as (select vec_id, label, embedding[1:32]::double[] as mu, embedding[33:64]::double[] as log_var from embeddings)
"""
