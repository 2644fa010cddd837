"""Rules that tell the statutory forms apart, and the roles that their documents play."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Texts printed on each form.
SB_STRONG = ["INDIAN CUSTOMS EDI SYSTEM", "SHIPPING BILL SUMMARY"]
SB_TOKEN_SETS = [["CUSTOMS", "EDI", "SYSTEM"], ["SHIPPING", "BILL", "SUMMARY"]]
SB_SUPPORT = ["SHIPPING BILL", "IEC/BR", "FOB VALUE", "PORT OF LOADING", "RODTEP", "RODTP"]
EBRC_TITLE = "STATEMENT OF BANK REALISATION"
EBRC = [EBRC_TITLE, "DIRECTORATE GENERAL OF FOREIGN TRADE", "REALISATION"]
EWB = ["E-WAY BILL SYSTEM", "E-WAY BILL NO"]
GSTR3B = ["GSTR-3B", "GSTR3B"]
GSTR1 = ["GSTR-1", "GSTR1"]
PF_COMBINED, PF_RECEIPT, PF_RETURN, PF_ECR = "COMBINED CHALLAN OF A/C", "PAYMENT CONFIRMATION RECEIPT", "ELECTRONIC CHALLAN CUM RETURN", "(ECR)"
PF = ["PROVIDENT FUND ORGANISATION", PF_COMBINED, PF_RECEIPT, PF_RETURN, PF_ECR]
ESIC_PERIOD = "CHALLAN PERIOD:"
ESIC = [ESIC_PERIOD, "EMPLOYEE'S STATE INSURANCE", "ESIC"]
PTRC_CHALLAN = ["MTR FORM", "00280012"]
PTRC = ["FORM_IIIB", "PROFESSION TAX", "PTRC", *PTRC_CHALLAN]
TDS_TITLES = ["INCOME TAX DEPARTMENT", "CHALLAN RECEIPT"]
TDS = [*TDS_TITLES, "TAN", "DATE OF DEPOSIT", "NATURE OF PAYMENT"]

#: A classification is accepted from this score on, and with this lead over the next.
ACCEPT_SCORE, ACCEPT_MARGIN = 70, 15


@dataclass(frozen=True)
class Form:
    """A form, in the order in which equal scores are ranked."""

    name: str
    profile: str
    required: tuple[str, ...] = ("EntityID", "PeriodDate", "DocRef")
    ocr_policy: str = "full"


FORMS = [
    Form("SB", "icegate-v1", ocr_policy="identify_then_skip"),
    Form("EBRC", "dgft-v1"),
    Form("EWB", "eway-v1"),
    Form("GSTR3B", "gst-3b-v1", ("EntityID", "PeriodDate")),
    Form("GSTR1", "gst-1-v1", ("EntityID", "PeriodDate")),
    Form("PF", "epfo-v1"),
    Form("ESIC", "esic-v1"),
    Form("PTRC", "ptrc-v1"),
    Form("TDS", "itns-v1"),
]


@dataclass(frozen=True)
class Roles:
    """Which kind of document states a demand and which settles it."""

    demand: str = "Return"
    settlement: str = "Challan"


ROLES: dict[str, Roles] = {"PF": Roles("Challan", "Payment"), "PTRC": Roles("Return", "Challan")}
KINDS = ["Return", "Challan", "Payment", "Arrears"]


@dataclass(frozen=True)
class AuditWeights:
    sparse: int = 15
    ocr: int = 20
    missing: int = 25
    unaccepted_cap: int = 50
    #: The challan form without an entity id can never be OK, unless this is dropped from its required fields.
    required: dict[str, tuple[str, ...]] = field(default_factory=lambda: {f.name: f.required for f in FORMS})


#: Columns of the ledger, in output order.
LEDGER_CORE = ["ReturnType", "DocKind", "EntityID", "EntityName", "FY", "PeriodDate", "MonthName", "MonthIndex", "Status", "Flags", "PrimaryAmount", "DocRef", "FilingDate", "SourceFile"]
LEDGER_AUDIT = ["Confidence", "ConfidenceGrade", "ProfileVersion", "ValidationFindings", "OCRUsed"]
