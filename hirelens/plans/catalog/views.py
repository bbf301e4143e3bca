"""Job-market readings of the shared tables, in expressions that both engines understand.

A posting is an order, its company a customer, its place a nation, its skills the words of the
parts on its lines. `{commas(x)}` differs per engine, so those expressions are functions.
"""

from __future__ import annotations

from functools import reduce

SPARK, DUCK = "spark", "duck"


def commas(number: str, engine: str) -> str:
    return f"format_number({number}, 0)" if engine == SPARK else f"format('{{:,}}', {number})"


def pay_text(engine: str, key: str = "o_orderkey", price: str = "o_totalprice") -> str:
    """Posting texts: no pay, ranges in several notations, a single amount, an hourly rate."""
    low = f"CAST(floor({price}) AS BIGINT)"
    a, b = commas(low, engine), commas(f"({low} + 25000)", engine)
    return (
        f"CASE CAST({key} % 6 AS INT) WHEN 0 THEN 'Competitive pay and benefits' "
        f"WHEN 1 THEN 'Pay $' || {a} || ' - $' || {b} || ' USD per year' "
        f"WHEN 2 THEN 'Pay $' || {a} || ' – $' || {b} || ' plus equity' "
        f"WHEN 3 THEN 'Gehalt €' || {a} || ' to €' || {b} || ' eur' "
        f"WHEN 4 THEN 'Base $' || {a} || ' only' "
        f"ELSE 'Rate £' || {a} || '—£' || {b} || ' per hour' END"
    )


PART_TITLE = "(p_name || ' ' || p_type)"


def last_word(engine: str) -> str:
    return "substring_index(p_name, ' ', -1)" if engine == SPARK else "string_split(p_name, ' ')[-1]"


def part_pay(engine: str) -> str:
    return commas("CAST(floor(p_retailprice * p_size) AS BIGINT)", engine)


# Part words read as terms of the trade; 'cold' goes before 'old', which it contains.
PART_WORD_TERMS = {
    "cold": "SLAM", "small": "LiDAR sensor calibration", "large": "object detection",
    "red": "motion planning", "blue": "HD map", "hot": "MPC", "new": "autonomous driving",
    "old": "ROS 2", "ring": "perception", "bolt": "C++", "gear": "C", "plate": "drive-by-wire",
    "anvil": "diagnostics", "rod": "trajectory prediction", "widget": "Lanelet2", "gizmo": "throttle",
}
# Part description in trade terms, e.g. "HD map, C++. ECONOMY".
PART_TEXT = (
    "(replace(" + reduce(
        lambda text, pair: f"replace({text}, '{pair[0]}', '{pair[1]}')",
        PART_WORD_TERMS.items(), "replace(p_name, ' ', ', ')",
    ) + ", '  ', ' ') || '. ' || p_type)"
)


def sql_words(text: str, keep: str = "", lower: bool = True) -> str:
    """The framed word text of `functions.skills.word_text`, in DuckDB."""
    body = f"lower({text})" if lower else text
    return rf"(' ' || trim(regexp_replace({body}, '[^\p{{L}}\p{{N}}_{keep}]+', ' ', 'g')) || ' ')"


def sql_matched(framed: str, terms) -> str:
    hits = ", ".join(f"CASE WHEN contains({framed}, ' {term} ') THEN '{term}' END" for term in terms)
    return f"list_filter([{hits}], lambda x: x IS NOT NULL)"


def sql_tokens(text: str, stop_words) -> str:
    words = ", ".join(f"'{word}'" for word in stop_words)
    split = f"string_split_regex(regexp_replace(lower({text}), '[^a-z0-9 ]', ' ', 'g'), ' +')"
    return f"list_distinct(list_filter({split}, lambda x: length(x) > 2 AND x NOT IN ({words})))"
