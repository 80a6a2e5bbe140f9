"""Fixed values of the order domain.

Everything here is data that results depend on, so it is stated as plain text. Every operator takes
these as arguments; the names below are only the defaults.
"""

# --- Fixed values: lines of business -----------------------------------------------------------
LINE_CODES = {
    "Gene Synthesis": "gs",
    "Molecular Genetics": "molgen",
    "Next Gen. Sequencing": "ngs",
    "Oligo Synthesis": "oligo",
    "Plasmid DNA Prep.": "prep",
    "Regulatory": "rs",
    "Sanger Sequencing": "sanger",
}
REMAPPED_LINES = {"Cloning and Mutagenesis": "Gene Synthesis"}
QUOTE_LINES_RAW = (
    "Cloning and Mutagenesis",
    "Gene Synthesis",
    "Next Gen. Sequencing",
    "Molecular Genetics",
    "Regulatory",
)
QUOTE_LINES = ("Gene Synthesis", "Next Gen. Sequencing", "Molecular Genetics", "Regulatory")

# --- Fixed values: order statuses ---------------------------------------------------------------
DIRECT_DROPPED_STATUSES = ("Cart", "Discard", "Draft", "Pending Quote", "Ready To Order")
QUOTE_DROPPED_STATUSES = ("Draft", "Pending Quote")
ISSUED_QUOTE_DROPPED_STATUSES = ("Cart", "Ready To Order")
NON_CONFIRMED_STATUSES = ("Cart", "Discard", "Ready To Order")

# --- Fixed values: territories outside the home market --------------------------------------------
EXCLUDED_TERRITORIES = (
    "20A", "20B", "20C", "20D",
    "21A", "21B", "21C", "21D",
    "22A", "22B", "22C", "22D",
    "30A", "EUBD", "40A",
)

# --- Fixed values: amounts written as text --------------------------------------------------------
ZERO_AMOUNT = "$0.0000"
FOREIGN_AMOUNT_PATTERNS = ("JPY.￥", "£", "€")
CONVERTED_MARK = "AU"
CONVERTED_RATE = 0.69

# --- Fixed values: attribution --------------------------------------------------------------------
NONE_OPEN = "none_open"
WINDOW_DAYS = 31
SCOPE_LINES = ("Next Gen. Sequencing", "Molecular Genetics", "Regulatory")
SCOPE_PRIORITY_LINE = "Gene Synthesis"

# --- Fixed values: labels of lines in report columns -----------------------------------------------
QUOTE_LABELS = {
    "NGS": "Next Gen. Sequencing",
    "GS": "Gene Synthesis",
    "Molgen": "Molecular Genetics",
    "RS": "Regulatory",
}
DIRECT_LABELS = {
    "Sanger": "Sanger Sequencing",
    "Prep": "Plasmid DNA Prep.",
    "Oligo": "Oligo Synthesis",
}
NEW_LINE_LABELS = {
    "NGS": "ngs",
    "GS": "gs",
    "MolGen": "molgen",
    "RS": "rs",
    "Sanger": "sanger",
    "Prep": "prep",
    "Oligo": "oligo",
}
BREAKDOWN_QUOTE_LABELS = {
    "NGS": "Next Gen. Sequencing",
    "GS": "Gene Synthesis",
    "MolGen": "Molecular Genetics",
    "RS": "Regulatory",
}
DETAIL_LABELS = {"MolGen": "Molecular Genetics", "RS": "Regulatory"}

# --- Fixed values: column names of input tables ----------------------------------------------------
ORDER_COLUMNS = {
    "CreatedDate": "created_date",
    "LineOfBusinessType": "lob_type",
    "OrderStatus": "order_status",
    "QuotationNumber": "quotation_number",
    "Territory": "territory",
    "BillingAmount": "billing_amount",
    "Institution": "institution",
    "CustomerEmail": "customer_email",
    "UserName": "user_name",
    "PromotionCode": "promotion_code",
    "Priority": "priority",
    "OrderType": "order_type",
}
HISTORY_COLUMNS = {"email": "customer_email", "email_+_lob": "email_lob"}
TOUCH_COLUMNS = {"recipient": "recipient", "sent_at_(your_time_zone)": "sent_at", "clicked": "clicked"}

# --- Fixed values: columns of the list of new customers ---------------------------------------------
CUSTOMER_LIST_COLUMNS = (
    "New Customer Type",
    "Customer Email",
    "Customer Name",
    "Institution",
    "Campaign Source",
    "First Order LoB",
)
NO_LINE = "N/A"
