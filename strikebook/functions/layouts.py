"""Record layouts of the clearing files.

Fixed values throughout: widths, kinds and constants of the published upload layouts. Each line
is "width kind source"; positions follow from the widths. Kinds: literal, text, number (zero
padded), digits (an account as its digits), amount.N (N implied decimals), date, blank.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Cell:
    width: int
    kind: str
    source: str | None
    decimals: int = 0


def cells(text: str) -> list[Cell]:
    found = []
    for line in text.strip().splitlines():
        width, kind, *source = line.split(maxsplit=2)
        kind, _, decimals = kind.partition(".")
        found.append(Cell(int(width), kind, source[0] if source else None, int(decimals or 0)))
    return found


def _start(line_type: str, operation: str) -> str:
    return f"5 literal COE\n1 literal {line_type}\n4 literal {operation}\n"


def header(operation: str, *more: str) -> str:
    return _start("0", operation) + "20 text participant\n8 date stamp\n" + "\n".join(more)


KEYED = "8 digits issuer_account\n11 text instrument_code\n"

REGISTRATION = _start("1", "0001") + """
8 digits issuer_account
2 text figure_ordinal
100 text commercial_name
8 date issue_date
8 date maturity_date
12 number quantity
20 amount.8 unit_issue_price
18 amount.2 notional
8 date forward_issue_date
12 text isin
2 text modality_code
7 amount.4 guaranteed_capital
7 amount.4 base_application
1 text cvm_resolution_8
2 text dividend_protection
1 text issuer_position
30 text asset_class
10 text asset
20 amount.8 initial_value
2 text maturity_remunerator
300 text remunerator_description
8 amount.4 floating_percentage
9 amount.4 coupon_rate
2 text day_count_basis
2 text early_redemption
1 text quanto
13 amount.8 initial_parity
3 number variable_count
20 text external_identifier
8 digits registrar_account
1 text physical_delivery
1 text has_cash_flow
8 date parity_start_date
8 date parity_fixing_date
20 amount.8 initial_remunerator_quote
8 date remunerator_start_date
8 date remunerator_fixing_date
1 text has_lookback
1 text lookback_criterion
8 date lookback_start
8 date lookback_end
1 text custody_regime
1 text extraordinary_payment
300 text physical_delivery_description
8 digits beneficiary_account
18 text beneficiary_document
2 text beneficiary_nature
10 digits my_number
20 amount.8 deposit_unit_price
1 text deposit_settlement_modality
8 digits settlement_bank
5 text early_redemption_condition
2 text functionality
1 text issuer_call_clause
""".lstrip("\n")

OPERATION_TAIL = """
16 blank
6 blank
8 digits holder_account
14 number quantity
15 blank
18 amount.8 unit_price
1 number settlement_modality
8 digits settlement_bank
8 blank
18 blank
""".lstrip("\n")
CLOSING = """
18 digits document
2 text nature
200 text reason
8 blank
18 blank
18 blank
1 blank
1 blank
2 blank
1 number block_type
8 blank
1 blank
""".lstrip("\n")
OPERATION_HEADER = header("LCOP", "5 number version", "1 literal <")
VERSIONED = ("5 number version",)

# name -> (record, declared length, text)
LAYOUTS: dict[str, dict[str, tuple[int, str]]] = {
    "Y1_registration": {
        "header": (38, header("0001")),
        "fixed": (1103, REGISTRATION),
        "variable": (326, _start("2", "0001") + "8 date stamp\n8 text field_code\n300 text field_value"),
    },
    "Y2_cash_flow": {
        "header": (38, header("FLUX")),
        "fixed": (61, _start("1", "FLUX") + KEYED + "20 text external_identifier\n2 text coupon_barrier_condition\n"
                  "2 text call_barrier_condition\n3 number variable_count\n1 text coupon_memory\n2 text flow_remunerator\n2 text flow_basis"),
        "variable": (101, _start("2", "FLUX") + "8 date payment_date\n8 amount.4 flow_rate\n9 amount.4 flow_spread\n12 amount.8 call_barrier\n"
                     "12 amount.8 coupon_barrier\n8 date fixing_date\n8 date fixing_date_2\n2 text fixing_type\n12 amount.8 coupon_barrier_2\n12 amount.8 call_barrier_2"),
    },
    "Y3_basket": {
        "header": (38, header("CEST")),
        "fixed": (77, _start("1", "CEST") + KEYED + "20 text external_identifier\n2 text basket_type\n2 number variable_count\n3 text parity_currency\n"
                  "13 amount.8 basket_initial_parity\n8 date basket_parity_fixing_date"),
        "variable": (58, _start("2", "CEST") + "10 text component\n2 text component_quote_type\n20 amount.8 component_initial_value\n8 date component_fixing_date\n8 amount.4 weight"),
    },
    "Y4_fixing_dates": {
        "header": (38, header("DTFX")),
        "fixed": (32, _start("1", "DTFX") + KEYED + "3 number variable_count"),
        "variable": (18, _start("2", "DTFX") + "8 date fixing_date"),
    },
    "Y5_custody_operation": {
        "header": (44, OPERATION_HEADER),
        "fixed": (471, "5 literal COE\n1 literal 1\n4 text operation_code\n14 text instrument_code\n1 blank\n2 number side\n8 digits issuer_account\n10 digits my_number\n"
                  + OPERATION_TAIL + "1 text technical_reserve\n8 date original_operation_date\n16 text original_operation_number\n1 blank\n8 blank\n1 blank\n" + CLOSING + "1 literal <"),
    },
    "Y6_same_day_deposit": {
        "header": (44, OPERATION_HEADER),
        "fixed": (520, "5 literal COE\n1 literal 1\n4 text operation_code\n14 blank\n1 blank\n2 number side\n8 digits issuer_account\n10 digits my_number\n"
                  + OPERATION_TAIL + "1 blank\n8 blank\n16 blank\n1 blank\n8 blank\n1 blank\n" + CLOSING + "1 blank\n8 blank\n18 blank\n2 blank\n20 text external_identifier\n1 literal <"),
    },
    "Y7_trigger": {
        "fixed": (76, "5 literal COE\n1 literal 1\n4 text operation_code\n11 text instrument_code\n10 text issuer_account\n8 date maturity_date\n1 text direction_code\n"
                  "8 date update_date\n8 date trigger_date\n20 amount.8 underlying_value"),
    },
    "Y8_price_update": {
        "header": (38, header("0810")),
        "fixed": (191, _start("1", "0810") + "11 text instrument_code\n10 text issuer_account\n2 text update_type\n8 date update_date\n20 amount.8 unit_price\n20 amount.8 underlying_value\n"
                  "20 amount.8 initial_underlying_value\n12 amount.6 currency_quote\n20 amount.8 remunerator_value\n20 amount.8 path_dependent_factor\n8 date lookback_reference_date\n"
                  "20 amount.8 lookback_initial_value\n10 text underlying_code"),
    },
    "Y9_mark_to_market": {
        "header": (38, header("0475")),
        "fixed": (56, _start("1", "0475") + "11 text instrument_code\n8 digits issuer_account\n8 date reference_date\n18 amount.8 market_value\n1 text sign"),
    },
    "Y10_notional_scenarios": {
        "header": (38, header("0848")),
        "fixed": (149, _start("1", "0848") + "11 text instrument_code\n20 amount.8 minimum_1\n20 amount.8 maximum_1\n20 amount.8 minimum_2\n20 amount.8 maximum_2\n40 text risk_factor\n8 date reference_date"),
    },
    "Y11_physical_delivery": {
        "header": (43, header("0855", *VERSIONED)),
        "fixed": (66, _start("1", "0855") + "8 text issuer_account\n14 text instrument_code\n17 amount.2 delivery_value\n17 amount.2 financial_value"),
    },
    "Y12_extraordinary_payment": {
        "header": (43, header("0808", *VERSIONED)),
        "fixed": (52, _start("1", "0808") + "8 text issuer_account\n14 text instrument_code\n20 amount.8 factor"),
    },
}
