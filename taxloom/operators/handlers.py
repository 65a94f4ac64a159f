"""What the papers of each type say: fields read from text, checked, corrected and enriched from highlights.

A field has an ordered list of patterns, of which the first that matches
decides. All of it is column expressions on a row: a handler is a dictionary of
columns over a text, so the same handler reads a paper or a highlight. Classes
like \\s and \\d are ASCII.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxloom.functions.validators import digits
from taxloom.operators.banking import LINE
from taxloom.operators.texts import bound

#: Patterns of the fields that all papers share, in the order in which they are tried.
DATES = [
    r"DATE:\s*(\d{1,2}[./]\d{1,2}[./]\d{4})",
    r"Date:\s*(\d{1,2}[./]\d{1,2}[./]\d{4})",
    r"\b(\d{1,2}/\d{1,2}/\d{4})\b",
    r"\b(\d{1,2}-\d{1,2}-\d{4})\b",
    r"\b(\d{1,2}\.\d{1,2}\.\d{4})\b",
]
TOTALS = [
    r"TOTAL:\s*\$?(\d+(?:\.\d{2})?)",
    r"\$(\d+\.\d{2})\s+TOTAL:",
    r"GST\s+\$[\d.]+\s+\$[\d.]+\s+\$(\d+\.\d{2})",
    r"Total:\s*\$?(\d+(?:\.\d{2})?)",
    r"(?:total|amount)\s*:?\s*\$?\s*(\d+(?:\.\d{2})?)",
    r"(?:grand\s+total)\s*:?\s*\$?\s*(\d+(?:\.\d{2})?)",
]
GST = [
    r"GST\s+\$[\d.]+\s+\$(\d+\.\d{2})\s+\$[\d.]+",
    r"TAX:\s*(\d+(?:\.\d{2})?)",
    r"GST:\s*\$?(\d+(?:\.\d{2})?)",
    r"(?:gst|tax)\s*:?\s*\$?\s*(\d+(?:\.\d{2})?)",
    r"(?:goods\s+and\s+services\s+tax)\s*:?\s*\$?\s*(\d+(?:\.\d{2})?)",
]
ABNS = [
    r"\b(?:abn\s*:?\s*)?(\d{2}\s+\d{3}\s+\d{3}\s+\d{3})\b",
    r"\b(?:abn\s*:?\s*)?(\d{11})\b",
]
SUPPLIERS = [r"STORE:\s*(.+?)(?:\n|$)", r"Supplier:\s*(.+?)(?:\n|$)"]
NAMES = ["woolworths", "coles", "aldi", "bunnings", "target", "kmart", "officeworks", "harvey norman", "jb hi-fi", "chemist warehouse", "bp", "shell", "caltex", "ampol", "7-eleven", "mcdonald's", "kfc", "subway"]

#: Bank statements.
BANKS = {
    "ANZ": r"\b(?:anz|australia and new zealand)\b",
    "Commonwealth Bank": r"\b(?:commonwealth|cba|commbank)\b",
    "Westpac": r"\bwestpac\b",
    "NAB": r"\b(?:nab|national australia bank)\b",
    "ING": r"\bing\s*(?:direct|bank)?\b",
    "Macquarie": r"\bmacquarie\s*(?:bank)?\b",
    "Bendigo Bank": r"\bbendigo\s*(?:bank)?\b",
    "Suncorp": r"\bsuncorp\s*(?:bank)?\b",
    "Bank of Queensland": r"\b(?:boq|bank of queensland)\b",
    "HSBC": r"\bhsbc\b",
    "Citibank": r"\bcitibank\b",
}
HOLDERS = [r"(?:account holder|customer|name)\s*:?\s*([A-Za-z\s]+)", r"(?:mr|mrs|ms|dr|prof)\.?\s+([A-Za-z\s]+)"]
BSBS = [r"(?:bsb|bank state branch)\s*:?\s*(\d{3}-\d{3})", r"(?:bsb|bank state branch)\s*:?\s*(\d{6})"]
ACCOUNTS = [r"(?:account|acc)\s*(?:no\.?|number)\s*:?\s*(\d{6,10})", r"(?:account|acc)\s*:?\s*(\d{6,10})"]
PERIODS = [
    r"(?:statement period|period)\s*:?\s*(\d{1,2}/\d{1,2}/\d{4})\s*(?:to|-)\s*(\d{1,2}/\d{1,2}/\d{4})",
    r"(?:from|start)\s*:?\s*(\d{1,2}/\d{1,2}/\d{4}).*?(?:to|end)\s*:?\s*(\d{1,2}/\d{1,2}/\d{4})",
]
OPENING = [
    r"(?:opening|previous|brought forward)\s*(?:balance)?\s*:?\s*\$?\s*([\-\+]?\d+(?:,\d{3})*(?:\.\d{2})?)",
    r"(?:balance\s*brought\s*forward)\s*:?\s*\$?\s*([\-\+]?\d+(?:,\d{3})*(?:\.\d{2})?)",
]
CLOSING = [
    r"(?:closing|final|current)\s*(?:balance)?\s*:?\s*\$?\s*([\-\+]?\d+(?:,\d{3})*(?:\.\d{2})?)",
    r"(?:balance\s*carried\s*forward)\s*:?\s*\$?\s*([\-\+]?\d+(?:,\d{3})*(?:\.\d{2})?)",
]
ACCOUNT_TYPES = [r"(?:account type|type)\s*:?\s*(savings?|cheque|checking|transaction|business|personal)", r"\b(savings?|cheque|transaction|business)\s*(?:account)?\b"]
WORK_PATTERNS = {
    "fuel": r"\b(?:bp|shell|caltex|ampol|mobil|7-eleven|fuel|petrol)\b",
    "parking": r"\b(?:parking|secure parking|wilson|ace park)\b",
    "toll": r"\b(?:toll|citylink|eastlink|etag)\b",
    "transport": r"\b(?:uber|taxi|cab|train|bus|metro|opal)\b",
    "accommodation": r"\b(?:hotel|motel|accommodation|booking\.com|airbnb)\b",
    "meals": r"\b(?:restaurant|cafe|lunch|dinner|coffee|meal)\b",
    "office": r"\b(?:officeworks|staples|office supplies|stationery)\b",
    "professional": r"\b(?:legal|lawyer|accountant|consultant|professional)\b",
    "equipment": r"\b(?:computer|laptop|software|equipment|tools)\b",
    "communications": r"\b(?:telstra|optus|vodafone|phone|internet|mobile)\b",
}
WORK_WORDS = ["office supplies", "fuel", "parking", "toll", "uber", "taxi", "hotel", "accommodation", "conference", "training", "software", "equipment", "travel", "meal", "restaurant", "coffee", "subscription", "professional", "legal", "accounting"]

#: Fuel receipts.
FUEL_TYPES = [r"(?:unleaded|ulp)\s*(?:91|95|98)?", r"premium\s*(?:unleaded|ulp)?\s*(?:95|98)", r"(?:diesel|dsl)", r"e10", r"e85", r"lpg", r"supreme\s*(?:unleaded|plus)"]
FUEL_CONTEXT = [r"(?:grade|octane)\s*(\d+)", r"(?:regular|standard)\s*unleaded", r"(?:super|supreme|premium)", r"(?:automotive|auto)\s*diesel"]
LITRES = [r"(\d+(?:\.\d{1,3})?)\s*(?:l|litres?|lts?)\b", r"(?:quantity|qty|litres?)\s*:?\s*(\d+(?:\.\d{1,3})?)", r"(\d+(?:\.\d{1,3})?)\s*(?:litres?|l)\s*@"]
PRICES = [
    r"@\s*\$?\s*(\d+(?:\.\d{1,3})?)\s*(?:per\s*)?(?:l|litre)",
    r"(\d+(?:\.\d{1,3})?)\s*(?:c|cents?)\s*(?:per\s*)?(?:l|litre)",
    r"price\s*(?:per\s*)?(?:l|litre)\s*:?\s*\$?\s*(\d+(?:\.\d{1,3})?)",
]
PUMPS = [r"pump\s*(?:no\.?|number|#)?\s*(\d+)", r"(?:pump|pos)\s*(\d+)"]
STATIONS = {
    "BP": r"\b(?:bp|british petroleum)\b",
    "Shell": r"\bshell\b",
    "Caltex": r"\bcaltex\b",
    "Ampol": r"\bampol\b",
    "Mobil": r"\bmobil\b",
    "7-Eleven": r"\b7.?eleven\b",
    "United Petroleum": r"\bunited\s*petroleum\b",
    "Liberty": r"\bliberty\s*(?:fuel|oil)?\b",
    "Metro Petroleum": r"\bmetro\s*petroleum\b",
    "Speedway": r"\bspeedway\b",
    "Puma Energy": r"\bpuma\s*energy\b",
    "Gull": r"\bgull\b",
    "Costco Fuel": r"\bcostco\s*fuel\b",
    "Woolworths Petrol": r"\bwoolworths\s*(?:petrol|fuel)\b",
    "Coles Express": r"\bcoles\s*express\b",
}
STATION_WORDS = {
    "BP": ["british petroleum", "bp"],
    "Shell": ["shell"],
    "Caltex": ["caltex"],
    "Ampol": ["ampol"],
    "Mobil": ["mobil", "exxonmobil"],
    "7-Eleven": ["7-eleven", "seven eleven", "711"],
    "United Petroleum": ["united", "united petroleum"],
    "Liberty": ["liberty", "liberty oil"],
    "Metro Petroleum": ["metro", "metro petroleum"],
}
STATES = [
    r"\b(?:nsw|new south wales)\b",
    r"\b(?:vic|victoria)\b",
    r"\b(?:qld|queensland)\b",
    r"\b(?:wa|western australia)\b",
    r"\b(?:sa|south australia)\b",
    r"\b(?:tas|tasmania)\b",
    r"\b(?:act|australian capital territory)\b",
    r"\b(?:nt|northern territory)\b",
]
POSTCODE = r"\b(\d{4})\b"
ADDRESS = r"\b(?:NSW|VIC|QLD|WA|SA|TAS|ACT|NT)\b|\b\d+\s+[A-Za-z\s]+(?:st|street|rd|road|ave|avenue|dr|drive)\b"
ODOMETERS = [r"(?:odometer|odo|km)\s*:?\s*(\d{1,7})", r"(\d{1,7})\s*(?:km|kilometres)"]
REGISTRATIONS = [r"(?:rego|registration|vehicle|plate)\s*:?\s*([A-Z0-9]{3,8})", r"\b([A-Z]{2,3}\s*[0-9]{2,3}[A-Z]?)\b", r"\b([0-9]{3}\s*[A-Z]{3})\b"]
KNOWN_FUELS = ["unleaded", "premium unleaded", "diesel", "e10", "e85", "lpg", "premium 95", "premium 98"]

#: Shop receipts.
CHAINS = {
    "Woolworths": r"\b(?:woolworths|woolies)\b",
    "Coles": r"\bcoles\s*(?:supermarket|express)?\b",
    "ALDI": r"\baldi\s*(?:australia)?\b",
    "Target": r"\btarget\s*(?:australia)?\b",
    "Kmart": r"\bk?mart\b",
    "Bunnings": r"\bbunnings\s*(?:warehouse)?\b",
    "Officeworks": r"\bofficeworks\b",
    "Harvey Norman": r"\bharvey\s*norman\b",
    "JB Hi-Fi": r"\bjb\s*hi.?fi\b",
    "Big W": r"\bbig\s*w\b",
    "Myer": r"\bmyer\b",
    "David Jones": r"\bdavid\s*jones\b",
    "Chemist Warehouse": r"\bchemist\s*warehouse\b",
    "Priceline": r"\bpriceline\s*pharmacy\b",
    "Spotlight": r"\bspotlight\b",
    "Rebel Sport": r"\brebel\s*sport\b",
    "IKEA": r"\bikea\b",
    "Costco": r"\bcostco\b",
}
CHAIN_WORDS = {
    "Woolworths": ["woolies", "ww", "fresh food people"],
    "Coles": ["coles supermarket", "coles express", "red hand"],
    "Target": ["target australia", "expect more pay less"],
    "Bunnings": ["bunnings warehouse", "lowest prices are just the beginning"],
    "Officeworks": ["officeworks", "office works"],
    "JB Hi-Fi": ["jb hifi", "jb hi fi", "for the love of tech"],
}
SUBTOTALS = [
    r"(?:subtotal|sub.?total)\s*:?\s*\$?\s*(\d+(?:\.\d{2})?)",
    r"(?:net|nett)\s*(?:total|amount)\s*:?\s*\$?\s*(\d+(?:\.\d{2})?)",
    r"(?:before\s*gst)\s*:?\s*\$?\s*(\d+(?:\.\d{2})?)",
]
DISCOUNTS = [
    r"(?:discount|savings?|off)\s*:?\s*\$?\s*(\d+(?:\.\d{2})?)",
    r"\-\s*\$?\s*(\d+(?:\.\d{2})?)\s*(?:discount|off)",
    r"(?:member|loyalty)\s*(?:discount|savings?)\s*:?\s*\$?\s*(\d+(?:\.\d{2})?)",
]
METHODS = ["cash", "credit", "debit", "eftpos", "card", "paywave", "contactless", "afterpay", "zip", "gift card"]
PAYMENTS = [r"(?:payment|paid|tender)\s*(?:method|type)?\s*:?\s*(\w+)", r"(\w+)\s*(?:card|payment)", r"(?:eftpos|credit|debit)\s*(\w*)"]
RECEIPTS = [
    r"(?:receipt|transaction|ref|reference)\s*(?:no\.?|number|#)?\s*:?\s*([A-Za-z0-9\-]+)",
    r"(?:txn|trans)\s*(?:no\.?|#)?\s*:?\s*([A-Za-z0-9\-]+)",
    r"(?:invoice|inv)\s*(?:no\.?|#)?\s*:?\s*([A-Za-z0-9\-]+)",
]
PLACES = [
    (r"\b(?:sydney|melbourne|brisbane|perth|adelaide|hobart|canberra|darwin)\b", 0),
    (r"\b(?:nsw|vic|qld|wa|sa|tas|act|nt)\b", 0),
    (POSTCODE, 0),
    (r"(?:store|branch)\s*(?:no\.?|#)?\s*:?\s*(\w+)", 1),
]
STORE_LINE = r"store\s*(?:no\.?|#)?\s*(\d+)\s*([A-Za-z\s]+)"
STREET_LINE = r"\d+\s+[A-Za-z\s]+(?:st|street|rd|road|ave|avenue)"
ITEM = r"^(.{3,40})\s+\$?(\d+(?:\.\d{2})?)\s*$"
NO_ITEM = r"^(?:total|subtotal|gst|tax|payment|change|tender)"
ITEM_WORDS = {
    "office_supplies": ["pen", "paper", "folder", "stapler", "ink", "toner", "notebook"],
    "computer_equipment": ["laptop", "mouse", "keyboard", "monitor", "cable", "usb", "hard drive"],
    "software": ["software", "license", "subscription", "antivirus", "office 365"],
    "stationery": ["envelope", "stamp", "business card", "letterhead"],
    "cleaning": ["cleaning", "sanitizer", "wipes", "soap", "detergent"],
    "catering": ["coffee", "tea", "biscuits", "water", "lunch", "meeting"],
    "marketing": ["banner", "sign", "brochure", "flyer", "promotional"],
    "tools": ["drill", "hammer", "screwdriver", "tape measure", "ladder"],
    "safety": ["helmet", "gloves", "vest", "first aid", "safety"],
}
LIKELIHOOD = {"office_supplies": 0.9, "computer_equipment": 0.9, "software": 0.9, "stationery": 0.9, "cleaning": 0.8, "tools": 0.8, "safety": 0.8, "marketing": 0.8, "catering": 0.6}
LOYALTY = {
    "everyday_rewards": r"everyday\s*rewards?\s*(?:card|member)?\s*:?\s*(\d+)",
    "flybuys": r"flybuys?\s*(?:card|member)?\s*:?\s*(\d+)",
    "target_circle": r"target\s*circle\s*(?:card|member)?\s*:?\s*(\d+)",
    "bunnings_membership": r"powerpass\s*(?:card|member)?\s*:?\s*(\d+)",
}
STAFF = [r"(?:cashier|operator|staff|served by)\s*:?\s*([A-Za-z\s]+)", r"(?:op|operator)\s*:?\s*(\w+)", r"(?:till|register)\s*(?:no\.?|#)?\s*(\d+)"]

#: Tax invoices.
SUPPLIER_ABNS = [r"(?:abn|australian business number)\s*:?\s*(\d{2}\s+\d{3}\s+\d{3}\s+\d{3})", r"(?:abn|australian business number)\s*:?\s*(\d{11})"]
MORE_ABNS = [r"(?:australian business number|a\.?b\.?n\.?)\s*:?\s*(\d{2}[\s-]?\d{3}[\s-]?\d{3}[\s-]?\d{3})", r"(?:abn|australian business number)\s*[:#-]?\s*(\d{11})"]
INVOICE_NUMBERS = [r"(?:invoice|inv)\s*(?:no\.?|number|#)\s*:?\s*([A-Za-z0-9\-]+)", r"(?:tax\s*)?invoice\s*:?\s*([A-Za-z0-9\-]+)"]
INVOICE_DATES = [r"(?:invoice\s*date|date\s*of\s*issue)\s*:?\s*(\d{1,2}/\d{1,2}/\d{4})", r"(?:issued|date)\s*:?\s*(\d{1,2}/\d{1,2}/\d{4})"]
DUE_DATES = [r"(?:due\s*date|payment\s*due)\s*:?\s*(\d{1,2}/\d{1,2}/\d{4})", r"(?:payable\s*by|due)\s*:?\s*(\d{1,2}/\d{1,2}/\d{4})"]
CUSTOMERS = [r"(?:bill\s*to|customer|client)\s*:?\s*([A-Za-z\s&]+)", r"(?:to|for)\s*:?\s*([A-Za-z\s&]+)"]
DESCRIPTIONS = [r"(?:description|services?|goods)\s*:?\s*([A-Za-z\s,.-]+)", r"(?:for|re)\s*:?\s*([A-Za-z\s,.-]+)"]
INVOICE_SUBTOTALS = [r"(?:subtotal|sub.?total|net)\s*:?\s*\$?\s*(\d+(?:\.\d{2})?)", r"(?:amount\s*before\s*gst)\s*:?\s*\$?\s*(\d+(?:\.\d{2})?)"]
PROFESSIONALS = [
    r"([A-Za-z\s&]+)\s+(?:lawyers?|solicitors?|barristers?)",
    r"([A-Za-z\s&]+)\s+(?:accountants?|accounting)",
    r"([A-Za-z\s&]+)\s+(?:consultants?|consulting)",
    r"([A-Za-z\s&]+)\s+(?:pty\.?\s*ltd\.?|limited|corp\.?)",
]
SERVICES = {
    "legal": ["lawyer", "solicitor", "barrister", "legal", "law firm"],
    "accounting": ["accountant", "accounting", "bookkeeper", "tax agent"],
    "consulting": ["consultant", "consulting", "advisory", "advisor"],
    "engineering": ["engineer", "engineering", "technical"],
    "medical": ["doctor", "medical", "dental", "clinic"],
    "it": ["technology", "software", "it services", "computer"],
}
TERMS = [r"(?:payment terms|terms)\s*:?\s*([A-Za-z0-9\s]+)", r"(?:net|due in)\s+(\d+)\s*days?", r"payment\s+due\s+on\s+receipt"]
NO_ADDRESS = r"^(?:abn|phone|email|fax)"

#: Starts of lines that are no station, no shop and no supplier.
FIRST_DIGIT, NO_NAME, NO_SUPPLIER = r"^\d", r"^\d|^[*=-]", r"^\d|^tax\s*invoice"

#: Amounts in a highlight; the first pattern that matches says which field it is, the last one asks the text.
_PAID = r"\s*:?\s*\$?\s*(\d+(?:\.\d{2})?)"
FUEL_HIGHLIGHT = [r"(?:total|amount|pay)" + _PAID, r"\$\s*(\d+(?:\.\d{2})?)", r"(\d+\.\d{2})\s*$"]
RECEIPT_HIGHLIGHT = {"total_amount": r"(?:total|amount|pay)" + _PAID, "gst_amount": r"(?:gst|tax)" + _PAID, "subtotal": r"(?:subtotal|sub.?total|net)" + _PAID}
INVOICE_HIGHLIGHT = {"total_amount": r"(?:total|amount due|amount payable)" + _PAID, "gst_amount": r"(?:gst|tax)" + _PAID, "subtotal": r"(?:subtotal|sub.?total|net)" + _PAID}
ANY_AMOUNT = r"\$\s*(\d+(?:\.\d{2})?)"
#: Fields that a sure highlight overrides.
PRIORITY = {
    "fuel_receipt": ["total_amount", "litres", "price_per_litre", "fuel_type", "pump_number", "date"],
    "business_receipt": ["total_amount", "gst_amount", "business_name", "date", "receipt_number", "subtotal"],
    "tax_invoice": ["total_amount", "gst_amount", "supplier_abn", "invoice_number", "invoice_date", "subtotal"],
}
#: Required and optional fields of the handlers.
FIELDS = {
    "bank_statement": (["bank_name", "account_holder", "account_number", "statement_period_from", "statement_period_to"], ["bsb", "opening_balance", "closing_balance", "transactions", "work_expenses", "total_debits", "total_credits", "account_type", "branch_details"]),
    "fuel_receipt": (["date", "fuel_type", "litres", "total_amount", "station_name"], ["price_per_litre", "gst_amount", "pump_number", "location", "abn", "odometer_reading", "vehicle_registration"]),
    "business_receipt": (["date", "business_name", "total_amount"], ["gst_amount", "subtotal", "abn", "items", "payment_method", "receipt_number", "store_location", "cashier_id", "discount_amount"]),
    "tax_invoice": (["supplier_name", "supplier_abn", "invoice_date", "invoice_number", "total_amount", "gst_amount"], ["customer_name", "customer_abn", "description", "subtotal", "due_date", "payment_terms", "supplier_address", "tax_invoice_indicator"]),
}
_SPACE = " \t\n\r\x0b\x0c"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(_SPACE))


def said(value: Column) -> Column:
    """A value that is not empty, or null."""
    return F.nullif(value, F.lit(""))


def some(array: Column) -> Column:
    """An array that is not empty, or null; computed once for a row."""
    return bound(array, lambda a: F.when(F.size(a) > 0, a))


def first(text: Column, patterns: list[str], group: int = 1, flags: str = "(?id)") -> Column:
    """What the first pattern that matches holds in a group."""
    return F.coalesce(*[said(F.regexp_extract(text, flags + p, group)) for p in patterns])


def number(text: Column, patterns: list[str]) -> Column:
    """As `first`, as a number without thousands separators; null for zero."""
    return F.nullif(F.replace(first(text, patterns), F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0))


def named(text: Column, patterns: dict[str, str]) -> Column:
    """The first name of which the pattern occurs."""
    out = None
    for name, p in patterns.items():
        out = F.when(text.rlike("(?id)" + p), name) if out is None else out.when(text.rlike("(?id)" + p), name)
    return out


def worded(low: Column, words: dict[str, list[str]]) -> Column:
    """The first name of which a word occurs."""
    out = None
    for name, own in words.items():
        hit = F.exists(F.array(*map(F.lit, own)), lambda w: low.contains(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def lines(text: Column, most: int | None = None) -> Column:
    """Lines without outer white space, `most` of them."""
    every = F.split(text, "\n")
    return F.transform(every if most is None else F.slice(every, 1, most), strip)


def first_line(text: Column, most: int, least: int, but: str) -> Column:
    """The first of `most` lines that has over `least` characters and does not start with what `but` matches."""
    return F.get(F.filter(lines(text, most), lambda x: (F.length(x) > least) & ~F.lower(x).rlike(but)), 0)


def common(text: Column) -> dict[str, Column]:
    """Date, total, GST, ABN and supplier, as on all papers."""
    supplier = F.coalesce(said(strip(first(text, SUPPLIERS))), *[said(F.regexp_extract(text, "(?i)" + name.replace(".", r"\."), 0)) for name in NAMES])
    return {"date": first(text, DATES), "total_amount": first(text, TOTALS).try_cast("double"), "gst_amount": first(text, GST).try_cast("double"), "abn": first(text, ABNS), "supplier_name": supplier, "business_name": supplier}


def transactions(text: Column) -> Column:
    """An array of date, description and amount of the lines that are transactions."""
    part = lambda x, k: F.regexp_extract(x, LINE, k)
    one = lambda x: F.struct(part(x, 1).alias("date"), strip(part(x, 2)).alias("description"), F.regexp_replace(part(x, 3), r"[$,]", "").try_cast("double").alias("amount"))
    return F.transform(F.filter(lines(text), lambda x: x.rlike(LINE)), one)


def work_expenses(txns: Column) -> Column:
    """Debits with a sign of work: one point for the first category, half a point for each word; two points are full confidence."""

    def judged(t: Column, low: Column) -> Column:
        words = F.size(F.filter(F.array(*map(F.lit, WORK_WORDS)), lambda w: low.contains(w)))
        return bound(F.struct(named(low, WORK_PATTERNS).alias("category"), words.alias("words")), lambda x: bound(F.when(x["category"].isNotNull(), 1.0).otherwise(0.0) + 0.5 * x["words"], lambda score: told(t, x["category"], score)))

    def told(t: Column, category: Column, score: Column) -> Column:
        return F.struct(t["date"].alias("date"), t["description"].alias("description"), t["amount"].alias("amount"), score.alias("work_score"), F.coalesce(category, F.lit("other")).alias("expense_category"), F.least(score / 2.0, F.lit(1.0)).alias("confidence"))

    scored = lambda t: bound(F.lower(t["description"]), lambda low: judged(t, low))
    return F.filter(F.transform(F.filter(txns, lambda t: t["amount"] < 0), scored), lambda e: e["work_score"] > 0)


def bank_statement(text: Column) -> dict[str, Column]:
    bank_line = F.get(F.filter(lines(text, 5), lambda x: F.lower(x).contains("bank")), 0)
    holder = F.coalesce(*[F.when(F.length(strip(first(text, [p]))) > 2, strip(first(text, [p]))) for p in HOLDERS])
    bsb = first(text, BSBS)
    balance = lambda patterns: F.coalesce(number(text, patterns), F.lit(0.0))
    return {
        "bank_name": F.coalesce(named(text, BANKS), bank_line),
        "account_holder": holder,
        "bsb": F.when(F.length(bsb) == 6, F.concat_ws("-", F.substring(bsb, 1, 3), F.substring(bsb, 4, 3))).otherwise(bsb),
        "account_number": first(text, ACCOUNTS),
        "statement_period_from": first(text, PERIODS, 1, "(?isd)"),
        "statement_period_to": first(text, PERIODS, 2, "(?isd)"),
        "opening_balance": balance(OPENING),
        "closing_balance": balance(CLOSING),
        "transactions": some(transactions(text)),
        "account_type": F.lower(first(text, ACCOUNT_TYPES)),
    }


def _location(text: Column) -> Column:
    state, code = F.upper(F.coalesce(*[said(F.regexp_extract(text, "(?i)" + p, 0)) for p in STATES])), first(text, [POSTCODE])
    return F.when(state.isNotNull(), F.concat_ws(", ", code, state)).otherwise(code)


def _price(text: Column) -> Column:
    price = number(text, PRICES)
    return F.when(price > 10.0, price / 100.0).otherwise(price)


def fuel_receipt(text: Column) -> dict[str, Column]:
    return {
        "fuel_type": strip(F.lower(first(text, FUEL_TYPES, 0))),
        "litres": number(text, LITRES),
        "price_per_litre": _price(text),
        "pump_number": first(text, PUMPS),
        "station_name": F.coalesce(named(text, STATIONS), first_line(text, 5, 3, FIRST_DIGIT)),
        "location": _location(text),
        "odometer_reading": first(text, ODOMETERS),
    }


def _fuel_in_context(text: Column) -> Column:
    """A grade from what else is said: the first sign that tells one."""
    out = []
    for p in FUEL_CONTEXT:
        m = F.lower(F.regexp_extract(text, "(?i)" + p, 0))
        out.append(
            F.when(m.contains("91") | m.contains("regular"), "unleaded 91")
            .when(m.contains("95") | m.contains("premium"), "premium unleaded 95")
            .when(m.contains("98") | m.contains("supreme"), "premium unleaded 98")
            .when(m.contains("diesel"), "diesel")
        )
    return F.coalesce(*out)


def fuel_receipt_more(text: Column, read: dict[str, Column]) -> dict[str, Column]:
    """What a closer look adds where the handler read nothing."""
    address = F.get(F.filter(lines(text), lambda x: x.rlike(POSTCODE) & x.rlike("(?i)" + ADDRESS)), 0)
    return {
        "station_name": F.coalesce(read["station_name"], worded(F.lower(text), STATION_WORDS)),
        "fuel_type": F.coalesce(read["fuel_type"], _fuel_in_context(text)),
        "location": F.coalesce(read["location"], address),
        "vehicle_registration": F.replace(F.upper(first(text, REGISTRATIONS)), F.lit(" "), F.lit("")),
    }


def items(text: Column) -> Column:
    """An array of description and amount of the lines that are items."""
    part = lambda x, k: F.regexp_extract(x, ITEM, k)
    one = lambda x: F.struct(strip(part(x, 1)).alias("description"), part(x, 2).try_cast("double").alias("amount"))
    return F.filter(F.transform(F.filter(lines(text), lambda x: x.rlike(ITEM)), one), lambda i: ~F.lower(i["description"]).rlike(NO_ITEM))


def categorised(found: Column) -> Column:
    """Items with a business category and how likely they are an expense of business."""

    def one(i: Column) -> Column:
        category = F.coalesce(worded(F.lower(i["description"]), ITEM_WORDS), F.lit("other"))
        likely = None
        for k, v in LIKELIHOOD.items():
            likely = F.when(category == k, v) if likely is None else likely.when(category == k, v)
        return F.struct(i["description"].alias("description"), i["amount"].alias("amount"), category.alias("business_category"), likely.otherwise(0.3).alias("likelihood"))

    return F.transform(found, one)


def _payment(text: Column) -> Column:
    listed = F.coalesce(*[F.when(text.rlike(rf"(?i)\b{m}\b"), m) for m in METHODS])
    paid = [F.lower(F.regexp_extract(text, "(?i)" + p, 1)) for p in PAYMENTS]
    return F.coalesce(listed, *[F.when(x.isin(*METHODS), x) for x in paid])


def business_receipt(text: Column) -> dict[str, Column]:
    found = items(text)
    return {
        "business_name": F.coalesce(named(text, CHAINS), first_line(text, 3, 2, NO_NAME)),
        "subtotal": number(text, SUBTOTALS),
        "payment_method": _payment(text),
        "receipt_number": first(text, RECEIPTS),
        "store_location": F.coalesce(*[said(F.regexp_extract(text, "(?i)" + p, g)) for p, g in PLACES]),
        "items": F.when(F.size(found) > 0, found),
        "discount_amount": number(text, DISCOUNTS),
    }


def business_receipt_more(text: Column, read: dict[str, Column]) -> dict[str, Column]:
    store = lambda x: F.concat(F.lit("Store "), F.regexp_extract(x, "(?i)" + STORE_LINE, 1), F.lit(" - "), strip(F.regexp_extract(x, "(?i)" + STORE_LINE, 2)))
    shown = F.transform(lines(text, 10), lambda x: F.when(x.rlike("(?i)" + STORE_LINE), store(x)).when(x.rlike("(?i)" + STREET_LINE), x))
    member = F.coalesce(*[F.when(text.rlike("(?i)" + p), F.struct(F.lit(k).alias("program"), F.regexp_extract(text, "(?i)" + p, 1).alias("member"))) for k, p in LOYALTY.items()])
    return {
        "business_name": F.coalesce(read["business_name"], worded(F.lower(text), CHAIN_WORDS)),
        "categorized_items": F.when(read["items"].isNotNull(), categorised(read["items"])),
        "loyalty_program": member["program"],
        "loyalty_member_id": member["member"],
        "store_location": F.coalesce(read["store_location"], F.get(F.filter(shown, lambda x: x.isNotNull()), 0)),
        "staff_id": said(strip(first(text, STAFF))),
    }


def tax_invoice(text: Column) -> dict[str, Column]:
    return {
        "supplier_name": first_line(text, 5, 3, NO_SUPPLIER),
        "supplier_abn": first(text, SUPPLIER_ABNS),
        "invoice_number": first(text, INVOICE_NUMBERS),
        "invoice_date": first(text, INVOICE_DATES),
        "customer_name": said(strip(first(text, CUSTOMERS))),
        "description": said(strip(first(text, DESCRIPTIONS))),
        "subtotal": number(text, INVOICE_SUBTOTALS),
        "due_date": first(text, DUE_DATES),
    }


def _spaced(d: Column) -> Column:
    return F.when(F.length(d) == 11, F.concat_ws(" ", F.substring(d, 1, 2), F.substring(d, 3, 3), F.substring(d, 6, 3), F.substring(d, 9, 3)))


def tax_invoice_more(text: Column, read: dict[str, Column]) -> dict[str, Column]:
    terms = [F.regexp_extract(text, "(?i)" + p, 0) for p in TERMS]
    told = [F.regexp_extract(text, "(?i)" + p, 1) for p in TERMS[:2]] + [F.lit("")]
    term = None
    for whole, part in zip(terms, told, strict=True):
        value = F.when(F.lower(whole).contains("receipt"), "Due on receipt").when(F.lower(whole).contains("days"), F.concat(F.lit("Net "), part, F.lit(" days"))).otherwise(strip(part))
        term = F.when(whole != "", value) if term is None else term.when(whole != "", value)
    every = lines(text)
    at = F.get(F.filter(F.transform(F.slice(every, 1, 10), lambda x, i: F.when(x.rlike(POSTCODE) & (F.size(_address_lines(every, i)) > 0), i)), lambda i: i.isNotNull()), 0)
    return {
        "supplier_abn": F.coalesce(_spaced(digits(read["supplier_abn"])), *[_spaced(digits(first(text, [p]))) for p in MORE_ABNS]),
        "supplier_name": F.coalesce(read["supplier_name"], said(strip(first(text, PROFESSIONALS)))),
        "service_type": worded(F.lower(text), SERVICES),
        "payment_terms": said(term),
        "supplier_address": F.when(at.isNotNull(), F.array_join(F.slice(_address_lines(every, at), 1, 3), ", ")),
    }


def _address_lines(every: Column, i: Column) -> Column:
    """Lines around line i, two before and one after, that may belong to an address."""
    start = F.greatest(i - 2, F.lit(0))
    near = F.slice(every, start + 1, i + 2 - start)
    return F.filter(near, lambda x: (F.length(x) > 5) & ~F.lower(x).rlike(NO_ADDRESS))


def merged(read: Column, more: Column) -> Column:
    """A field after a closer look: what was read unless it is empty or the new text is longer."""
    return F.when(F.coalesce(read, F.lit("")) == "", more).when(F.length(more) > F.length(read), more).otherwise(read)


HANDLERS: dict[str, Callable[[Column], dict[str, Column]]] = {"bank_statement": bank_statement, "fuel_receipt": fuel_receipt, "business_receipt": business_receipt, "tax_invoice": tax_invoice}
MORE: dict[str, Callable[[Column, dict[str, Column]], dict[str, Column]]] = {"fuel_receipt": fuel_receipt_more, "business_receipt": business_receipt_more, "tax_invoice": tax_invoice_more}


def contained_name(text: Column) -> Column:
    """The first well-known business in the text, as it is written there."""
    return F.coalesce(*[said(F.regexp_extract(text, "(?i)" + name, 0)) for name in NAMES])


def read(docs: DataFrame, doc_type: str, text_col: str = "text") -> DataFrame:
    """docs (of one type) with a column for each field: common fields, those of the type in their place, and a closer look.

    Meal receipts and other documents add a contained business name; the
    remaining types have the common fields only.
    """
    rows = docs.withColumns(common(F.col(text_col)))
    if doc_type in ("meal_receipt", "other"):
        return rows.withColumn("restaurant_name" if doc_type == "meal_receipt" else "business_name", F.coalesce(contained_name(F.col(text_col)), F.lit(None) if doc_type == "meal_receipt" else F.col("business_name")))
    if doc_type not in HANDLERS:
        return rows
    own = HANDLERS[doc_type](F.col(text_col))
    # A type's own field stands before the common one of that name, where it was read.
    rows = rows.withColumns({k: F.coalesce(c, F.col(k)) if k in rows.columns else c for k, c in own.items()})
    if doc_type == "bank_statement":
        return rows.withColumn("work_expenses", some(work_expenses(F.col("transactions"))))
    more = MORE[doc_type](F.col(text_col), {k: F.col(k) for k in own})
    return rows.withColumns({k: merged(F.col(k), c) if k in rows.columns else c for k, c in more.items()})


def _money(c: Column) -> Column:
    return F.format_string("%.2f", c)


def _said_if(*pairs: tuple[Column, Column | str]) -> Column:
    return F.filter(F.array(*[F.when(c, F.lit(m) if isinstance(m, str) else m) for c, m in pairs]), lambda x: x.isNotNull())


def _out(value: Column, lo: float, hi: float) -> Column:
    return F.coalesce((value != 0) & ~value.between(lo, hi), F.lit(False))


def tax_issues(rows: DataFrame) -> Column:
    """What is wrong with ABN, GST and date, on any paper."""
    abn, total, gst = F.replace(F.col("abn"), F.lit(" "), F.lit("")), F.col("total_amount"), F.col("gst_amount")
    expected = total * 0.10 / 1.10
    return _said_if(
        (~abn.rlike(r"^\d{11}$"), "Invalid ABN format (must be 11 digits)"),
        ((total != 0) & (gst != 0) & (F.abs(gst - expected) > 0.05), F.concat(F.lit("GST amount "), _money(gst), F.lit(" may be incorrect (expected ~"), _money(expected), F.lit(")"))),
        (~F.col("date").rlike(r"^\d{1,2}/\d{1,2}/\d{4}"), "Date should be in DD/MM/YYYY format"),
    )


def missing(doc_type: str, rows: DataFrame) -> Column:
    """Which required fields were not read."""
    return _said_if(*[(~_there(rows, f), f"Missing required field: {f}") for f in FIELDS[doc_type][0]])


def _there(rows: DataFrame, field: str) -> Column:
    if field not in rows.columns:
        return F.lit(False)
    kind = rows.schema[field].dataType.simpleString()
    c = F.col(field)
    if kind == "double":
        return F.coalesce(c != 0, F.lit(False))
    return F.coalesce(c != "", F.lit(False)) if kind == "string" else c.isNotNull()


def _sums(subtotal: Column, gst: Column, total: Column) -> Column:
    return (subtotal != 0) & (gst != 0) & (total != 0)


def own_issues(doc_type: str) -> Column:
    """What is wrong with a type's own fields."""
    c = F.col
    if doc_type == "bank_statement":
        worded_balance = lambda f: F.concat(F.lit(f.replace("_", " ").title() + " $"), F.format_number(c(f), 2), F.lit(" outside reasonable range"))
        fixed = _said_if(
            (~c("bsb").rlike(r"^\d{3}-\d{3}$"), F.concat(F.lit("Invalid BSB format: "), c("bsb"), F.lit(" (should be XXX-XXX)"))),
            (~F.length("account_number").between(6, 10), F.concat(F.lit("Account number length "), F.length("account_number").cast("string"), F.lit(" outside range (6-10)"))),
            *[(~c(f).between(-100000.0, 1000000.0), worded_balance(f)) for f in ("opening_balance", "closing_balance")],
        )
        one = lambda t, i: F.when(~t["amount"].between(-50000.0, 50000.0), F.concat(F.lit("Transaction "), (i + 1).cast("string"), F.lit(" amount $"), F.format_number(t["amount"], 2), F.lit(" outside reasonable range")))
        return F.concat(fixed, F.filter(F.coalesce(F.transform("transactions", one), F.expr("cast(array() as array<string>)")), lambda x: x.isNotNull()))
    total = c("total_amount")
    if doc_type == "fuel_receipt":
        known = F.exists(F.array(*map(F.lit, KNOWN_FUELS)), lambda k: F.lower(c("fuel_type")).contains(k))
        calculated = c("litres") * c("price_per_litre")
        apart = F.abs(calculated - total) > F.greatest(calculated * 0.15, F.lit(2.0))
        return _said_if(
            (~known, F.concat(F.lit("Unrecognized fuel type: "), c("fuel_type"))),
            (_out(c("litres"), 1.0, 200.0), F.concat(F.lit("Fuel quantity "), c("litres").cast("string"), F.lit("L outside reasonable range (1.0-200.0L)"))),
            (_out(c("price_per_litre"), 1.0, 3.0), F.concat(F.lit("Price per litre $"), F.format_string("%.3f", c("price_per_litre")), F.lit(" outside reasonable range ($1.0-$3.0)"))),
            (_out(total, 5.0, 500.0), F.concat(F.lit("Total amount $"), _money(total), F.lit(" outside reasonable range ($5.0-$500.0)"))),
            ((total != 0) & apart, F.concat(F.lit("Calculated total $"), _money(calculated), F.lit(" differs significantly from stated total $"), _money(total))),
        )
    subtotal, gst = c("subtotal"), c("gst_amount")
    expected = subtotal * 0.10
    if doc_type == "business_receipt":
        listed = F.round(F.aggregate("items", F.lit(0.0), lambda acc, i: acc + i["amount"]), 6)
        return _said_if(
            (_out(total, 0.01, 10000.0), F.concat(F.lit("Total amount $"), _money(total), F.lit(" outside reasonable range ($0.01-$10000.0)"))),
            (~F.lower("payment_method").isin(*METHODS), F.concat(F.lit("Unrecognized payment method: "), c("payment_method"))),
            (_sums(subtotal, gst, total) & (F.abs(subtotal + gst - total) > 0.05), F.concat(F.lit("Subtotal + GST ($"), _money(subtotal + gst), F.lit(") does not equal total ($"), _money(total), F.lit(")"))),
            (_sums(subtotal, gst, total) & (F.abs(gst - expected) > 0.05), F.concat(F.lit("GST amount $"), _money(gst), F.lit(" does not match expected 10% ($"), _money(expected), F.lit(")"))),
            (F.abs(listed - total) > F.greatest(total * 0.20, F.lit(5.0)), F.concat(F.lit("Items total $"), _money(listed), F.lit(" differs significantly from receipt total $"), _money(total))),
        )
    return _said_if(
        (~F.coalesce(c("tax_invoice_indicator"), F.lit(False)), "Document should contain 'Tax Invoice' text"),
        (~F.replace(c("supplier_abn"), F.lit(" "), F.lit("")).rlike(r"^\d{11}$"), "Invalid supplier ABN format"),
        (_sums(subtotal, gst, total) & (F.abs(gst - expected) > 0.05), F.concat(F.lit("GST amount may be incorrect (expected $"), _money(expected), F.lit(")"))),
        (_sums(subtotal, gst, total) & (F.abs(total - (subtotal + gst)) > 0.05), F.concat(F.lit("Total amount may be incorrect (expected $"), _money(subtotal + gst), F.lit(")"))),
    )


def checked(rows: DataFrame, doc_type: str) -> DataFrame:
    """rows (as `read` returns them) with issues and field_confidence: completeness, less a tenth for each issue, more for ABN and GST."""
    if doc_type == "tax_invoice" and "tax_invoice_indicator" not in rows.columns:
        rows = rows.withColumn("tax_invoice_indicator", F.lit(None).cast("boolean"))
    rows = rows.withColumn("issues", F.concat(missing(doc_type, rows), own_issues(doc_type), tax_issues(rows)))
    names = [*FIELDS[doc_type][0], *FIELDS[doc_type][1]]
    have = sum((_there(rows, f).cast("int") for f in names), F.lit(0))
    bonus = F.when(_there(rows, "abn"), 0.1).otherwise(0.0) + F.when(_there(rows, "gst_amount"), 0.1).otherwise(0.0)
    score = have / len(names) - F.least(0.1 * F.size("issues"), F.lit(0.5)) + bonus
    return rows.withColumn("field_confidence", F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)))


def from_highlight(text: Column, doc_type: str) -> dict[str, Column]:
    """The fields that one highlight of a type's paper tells."""
    if doc_type == "bank_statement":
        return {"opening_balance": number(text, OPENING), "closing_balance": number(text, CLOSING)}
    if doc_type == "fuel_receipt":
        own = fuel_receipt(text)
        return {k: own[k] for k in ("fuel_type", "litres", "price_per_litre", "pump_number")} | {"total_amount": number(text, FUEL_HIGHLIGHT), "date": first(text, DATES)}
    patterns = RECEIPT_HIGHLIGHT if doc_type == "business_receipt" else INVOICE_HIGHLIGHT
    read = {f: F.regexp_extract(text, "(?i)" + p, 1) for f, p in patterns.items()}
    kind = None
    for f in patterns:
        kind = F.when(read[f] != "", f) if kind is None else kind.when(read[f] != "", f)
    low, any_amount = F.lower(text), F.regexp_extract(text, ANY_AMOUNT, 1)
    told = F.when(low.contains("total"), "total_amount").when(low.contains("gst") | low.contains("tax"), "gst_amount").when(low.contains("sub"), "subtotal").otherwise("highlight_amount")
    kind = kind.otherwise(F.when(any_amount != "", told))
    value = F.coalesce(*[said(read[f]) for f in patterns], said(any_amount)).try_cast("double")
    amounts = {f: F.nullif(F.when(kind == f, value), F.lit(0.0)) for f in patterns}
    if doc_type == "business_receipt":
        own = business_receipt(text)
        return {k: own[k] for k in ("business_name", "receipt_number", "payment_method")} | amounts | {"highlight_amount": F.when(kind == "highlight_amount", value), "date": first(text, DATES), "abn": first(text, ABNS)}
    own = tax_invoice(text)
    return {k: own[k] for k in ("supplier_name", "supplier_abn", "invoice_number", "invoice_date", "description", "customer_name")} | amounts


def enriched(rows: DataFrame, highlights: DataFrame, doc_type: str, by: str = "doc_id") -> DataFrame:
    """rows with what their highlights (`by`, ord, text, confidence) add, in the order of `ord`.

    A field that was not read takes the first highlight's value; a priority
    field takes the last one of confidence over 0.7, even if it was read.
    Invoices gain tax_invoice_indicator where a highlight says so. The
    highlights of a paper are combined by aggregation, so none is collected.
    """
    told = highlights.withColumns({f"h_{k}": c for k, c in from_highlight(F.col("text"), doc_type).items()})
    names = [c[2:] for c in told.columns if c.startswith("h_")]
    sure = F.col("confidence") > 0.7
    picks = []
    for k in names:
        held = F.col(f"h_{k}").isNotNull()
        picks.append(F.min_by(f"h_{k}", F.when(held, F.col("ord"))).alias(f"first_{k}"))
        # Balances of a statement: the last one told stands.
        last = held if doc_type == "bank_statement" else held & sure
        picks.append(F.max_by(f"h_{k}", F.when(last, F.col("ord"))).alias(f"last_{k}"))
    indicator = F.lower("text").contains("tax invoice") | F.lower("text").contains("gst invoice")
    if doc_type == "tax_invoice":
        picks.append(F.max(F.when(indicator, True)).alias("tax_invoice_indicator"))
    out = rows.join(told.groupBy(by).agg(*picks), by, "left")
    new = {}
    for k in names:
        first_one, last_one = F.col(f"first_{k}"), F.col(f"last_{k}")
        if k not in rows.columns:
            new[k] = F.coalesce(last_one, first_one) if k in PRIORITY.get(doc_type, []) else first_one
        elif doc_type == "bank_statement":
            new[k] = F.coalesce(last_one, F.col(k))
        else:
            empty = ~_there(rows, k)
            kept = F.when(empty, first_one).otherwise(F.col(k))
            new[k] = F.coalesce(last_one, kept) if k in PRIORITY[doc_type] else kept
    return corrected(out.withColumns(new).drop(*[f"{w}_{k}" for k in names for w in ("first", "last")]), doc_type)


def corrected(rows: DataFrame, doc_type: str) -> DataFrame:
    """rows with totals and GST that follow from the other figures, and `correction`, which says what was derived."""
    total = F.col("total_amount")
    if doc_type == "fuel_receipt":
        calculated = F.col("litres") * F.col("price_per_litre")
        none = F.coalesce(total, F.lit(0.0)) == 0
        wrong = ~none & (F.abs(calculated - total) > 2.0) & calculated.between(5.0, 500.0)
        why = F.when(calculated.isNotNull() & none, "calculated_total").when(wrong, "corrected_from_calculation")
        rows = rows.withColumn("correction", why)
        return rows.withColumn("total_amount", F.when(F.col("correction").isNotNull(), calculated).otherwise(total))
    if doc_type == "bank_statement":
        return rows
    subtotal, gst = F.col("subtotal"), F.col("gst_amount")
    has = lambda c: F.coalesce(c != 0, F.lit(False))
    both, rest = has(subtotal) & has(total), total - subtotal
    closer = (F.abs(rest - gst) > 0.10) & (rest > 0) & (F.abs(rest - subtotal * 0.10) < F.abs(gst - subtotal * 0.10))
    derive = both & ~has(gst) & ((rest > 0) if doc_type == "business_receipt" else F.lit(True))
    why = F.when(derive, "calculated_gst").when(both & has(gst) & closer, "corrected_gst").when(~both & has(subtotal) & has(gst) & ~has(total), "calculated_total")
    if doc_type == "business_receipt":
        listed = F.aggregate("items", F.lit(0.0), lambda acc, i: acc + i["amount"])
        why = why.when(~has(total) & F.col("items").isNotNull() & ~(has(subtotal) & has(gst)), "estimated_from_items")
    rows = rows.withColumn("correction", why)
    fixed = F.when(F.col("correction") == "calculated_total", subtotal + gst)
    if doc_type == "business_receipt":
        fixed = fixed.when(F.col("correction") == "estimated_from_items", listed * 1.10)
    return rows.withColumns({"gst_amount": F.when(F.col("correction").isin("calculated_gst", "corrected_gst"), rest).otherwise(gst), "total_amount": fixed.otherwise(total)})


def deduplicated(lines: DataFrame, keys: list[Column], by: str = "doc_id") -> DataFrame:
    """One of the lines (`by`, ord, highlighted, ...) that share `keys`: the last highlighted one, else the first; in the place of the first."""
    names = [f"key_{k}" for k in range(len(keys))]
    rows = lines.withColumns(dict(zip(names, keys, strict=True)))
    row = F.struct(*[F.col(c) for c in lines.columns])
    # A highlighted line replaces what stands there only if something stands there already.
    best = F.coalesce(F.max_by(row, F.when(F.col("highlighted"), F.col("ord"))), F.min_by(row, F.col("ord")))
    out = rows.groupBy(by, *names).agg(F.min("ord").alias("place"), best.alias("row"))
    return out.select("row.*", "place")
