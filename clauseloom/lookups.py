"""Lookup data of the clause model and the frames built from it.

Everything in capitals is a fixed value: it must equal the published clause
model for results to be right, and is therefore stated as plain text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Question label -> clause type, in routing order.
CLAUSE_MAPPINGS = [
    ("Document Name", "document_name"),
    ("Parties", "parties"),
    ("Agreement Date", "agreement_date"),
    ("Effective Date", "effective_date"),
    ("Expiration Date", "expiration_date"),
    ("Renewal Term", "renewal_term"),
    ("Notice Period To Terminate Renewal", "notice_period_renewal"),
    ("Termination For Convenience", "termination_convenience"),
    ("Governing Law", "governing_law"),
    ("Most Favored Nation", "most_favored_nation"),
    ("Non-Compete", "non_compete"),
    ("Exclusivity", "exclusivity"),
    ("No-Solicit Of Customers", "no_solicit_customers"),
    ("Competitive Restriction Exception", "competitive_restriction_exception"),
    ("No-Solicit Of Employees", "no_solicit_employees"),
    ("Non-Disparagement", "non_disparagement"),
    ("Rofr/Rofo/Rofn", "right_of_first_refusal"),
    ("Change Of Control", "change_of_control"),
    ("Anti-Assignment", "anti_assignment"),
    ("Revenue/Profit Sharing", "revenue_profit_sharing"),
    ("Price Restrictions", "price_restrictions"),
    ("Minimum Commitment", "minimum_commitment"),
    ("Volume Restriction", "volume_restriction"),
    ("Ip Ownership Assignment", "ip_ownership_assignment"),
    ("Joint Ip Ownership", "joint_ip_ownership"),
    ("License Grant", "license_grant"),
    ("Non-Transferable License", "non_transferable_license"),
    ("Affiliate License-Licensor", "affiliate_license_licensor"),
    ("Affiliate License-Licensee", "affiliate_license_licensee"),
    ("Unlimited/All-You-Can-Eat-License", "unlimited_license"),
    ("Irrevocable Or Perpetual License", "irrevocable_perpetual_license"),
    ("Source Code Escrow", "source_code_escrow"),
    ("Post-Termination Services", "post_termination_services"),
    ("Audit Rights", "audit_rights"),
    ("Uncapped Liability", "uncapped_liability"),
    ("Cap On Liability", "cap_on_liability"),
    ("Liquidated Damages", "liquidated_damages"),
    ("Warranty Duration", "warranty_duration"),
    ("Insurance", "insurance"),
    ("Covenant Not To Sue", "covenant_not_to_sue"),
    ("Third Party Beneficiary", "third_party_beneficiary"),
]

# Words ignored when a question is matched by key words.
ROUTING_STOPWORDS = ["of", "to", "the", "and", "or", "for"]
ROUTING_SHARE = 0.7

# Clause type -> variables and their types, in schema order.
VARIABLE_SCHEMA = [
    ("parties", [("parties", "Party[]")]),
    ("effective_date", [("effectiveDate", "DateTime")]),
    ("expiration_date", [
        ("expirationDate", "DateTime"),
        ("contractDuration", "Duration"),
        ("isAutomaticRenewal", "Boolean"),
    ]),
    ("agreement_date", [("signatureDate", "DateTime")]),
    ("governing_law", [("governingLaw", "String"), ("governingJurisdiction", "String")]),
    ("renewal_term", [("renewalDuration", "Duration"), ("isAutomaticRenewal", "Boolean")]),
    ("notice_period_renewal", [("renewalNoticePeriod", "Duration"), ("noticePeriodToTerminate", "Duration")]),
    ("termination_convenience", [
        ("canTerminateForConvenience", "Boolean"),
        ("terminationFee", "MonetaryAmount"),
        ("terminationNoticePeriod", "Duration"),
    ]),
    ("most_favored_nation", [("hasMostFavoredNation", "Boolean")]),
    ("non_compete", [("hasNonCompete", "Boolean"), ("nonCompeteDuration", "Duration")]),
    ("exclusivity", [("isExclusive", "Boolean")]),
    ("no_solicit_customers", [("hasNonSolicitCustomer", "Boolean")]),
    ("competitive_restriction_exception", [("hasCompetitiveRestrictionException", "Boolean")]),
    ("no_solicit_employees", [("hasNonSolicitEmployee", "Boolean"), ("employeeSolicitationDuration", "Duration")]),
    ("non_disparagement", [
        ("hasNonDisparagement", "Boolean"),
        ("nonDisparagementDuration", "Duration"),
        ("mutualNonDisparagement", "Boolean"),
    ]),
    ("right_of_first_refusal", [("hasRightOfFirstRefusal", "Boolean"), ("rofrNoticePeriod", "Duration")]),
    ("change_of_control", [
        ("hasChangeOfControlClause", "Boolean"),
        ("requiresChangeOfControlNotice", "Boolean"),
        ("changeOfControlNoticePeriod", "Duration"),
    ]),
    ("anti_assignment", [("hasAssignmentRestriction", "Boolean")]),
    ("revenue_profit_sharing", [("hasRevenueSharing", "Boolean"), ("revenueSharePercentage", "Double")]),
    ("price_restrictions", [("hasPriceRestrictions", "Boolean"), ("pricingStructure", "String")]),
    ("minimum_commitment", [
        ("hasMinimumCommitment", "Boolean"),
        ("minimumCommitmentAmount", "MonetaryAmount"),
        ("minimumCommitmentVolume", "Double"),
    ]),
    ("volume_restriction", [("hasVolumeRestriction", "Boolean"), ("volumeLimit", "Double")]),
    ("ip_ownership_assignment", [("assignsIPOwnership", "Boolean")]),
    ("joint_ip_ownership", [("hasJointIPOwnership", "Boolean")]),
    ("license_grant", [("licenseScope", "String")]),
    ("non_transferable_license", [("isTransferable", "Boolean"), ("transferRequiresConsent", "Boolean")]),
    ("affiliate_license_licensor", [("includesLicensorAffiliateIP", "Boolean")]),
    ("affiliate_license_licensee", [("includesLicenseeAffiliateIP", "Boolean")]),
    ("unlimited_license", [("hasUnlimitedLicense", "Boolean")]),
    ("irrevocable_perpetual_license", [("hasIrrevocableLicense", "Boolean"), ("isPerpetual", "Boolean")]),
    ("source_code_escrow", [("hasSourceCodeEscrow", "Boolean")]),
    ("post_termination_services", [
        ("hasPostTerminationObligations", "Boolean"),
        ("postTerminationDuration", "Duration"),
    ]),
    ("audit_rights", [
        ("hasAuditRights", "Boolean"),
        ("auditFrequency", "Duration"),
        ("auditNoticePeriod", "Duration"),
    ]),
    ("uncapped_liability", [("hasUncappedLiability", "Boolean")]),
    ("cap_on_liability", [
        ("hasCapOnLiability", "Boolean"),
        ("capAmount", "MonetaryAmount"),
        ("CapPeriod", "Duration"),
        ("isCapCalculated", "Boolean"),
    ]),
    ("liquidated_damages", [
        ("hasLiquidatedDamagesClause", "Boolean"),
        ("liquidatedDamagesAmount", "MonetaryAmount"),
        ("isDamagesCalculated", "Boolean"),
        ("damagesCalculationBasis", "String"),
    ]),
    ("warranty_duration", [("hasWarrantyObligation", "Boolean"), ("warrantyDuration", "Duration")]),
    ("insurance", [
        ("hasInsuranceRequirement", "Boolean"),
        ("insuranceCoverageAmount", "MonetaryAmount"),
        ("additionalInsured", "Boolean"),
        ("InsurancePeriod", "Duration"),
        ("isInsuranceCalculated", "Boolean"),
        ("insuranceCalculationBasis", "String"),
    ]),
    ("covenant_not_to_sue", [("hasCovenantNotToSue", "Boolean"), ("covenantDuration", "Duration")]),
    ("third_party_beneficiary", [("hasThirdPartyBeneficiary", "Boolean")]),
    ("document_name", [("documentTitle", "String")]),
]

# Clause type -> library template.
TEMPLATE_MAP = [
    ("document_name", "contract-header@1.0.0"),
    ("parties", "party-identification@1.0.0"),
    ("agreement_date", "execution-date@1.0.0"),
    ("effective_date", "effective-date@1.0.0"),
    ("expiration_date", "expiration-clause@1.0.0"),
    ("governing_law", "governing-law@1.0.0"),
    ("renewal_term", "renewal-clause@1.0.0"),
    ("notice_period_renewal", "notice-clause@1.0.0"),
    ("termination_convenience", "termination-clause@1.0.0"),
    ("most_favored_nation", "mfn-clause@1.0.0"),
    ("non_compete", "non-compete@1.0.0"),
    ("exclusivity", "exclusivity-clause@1.0.0"),
    ("no_solicit_customers", "non-solicitation@1.0.0"),
    ("competitive_restriction_exception", "restriction-exception@1.0.0"),
    ("no_solicit_employees", "employee-non-solicitation@1.0.0"),
    ("non_disparagement", "non-disparagement@1.0.0"),
    ("right_of_first_refusal", "rofr-clause@1.0.0"),
    ("change_of_control", "change-control@1.0.0"),
    ("anti_assignment", "assignment-restriction@1.0.0"),
    ("revenue_profit_sharing", "revenue-sharing@1.0.0"),
    ("price_restrictions", "pricing-clause@1.0.0"),
    ("minimum_commitment", "commitment-clause@1.0.0"),
    ("volume_restriction", "volume-clause@1.0.0"),
    ("ip_ownership_assignment", "ip-assignment@1.0.0"),
    ("joint_ip_ownership", "joint-ip@1.0.0"),
    ("license_grant", "license-clause@1.0.0"),
    ("non_transferable_license", "license-transfer@1.0.0"),
    ("affiliate_license_licensor", "affiliate-license@1.0.0"),
    ("affiliate_license_licensee", "licensee-affiliate@1.0.0"),
    ("unlimited_license", "unlimited-license@1.0.0"),
    ("irrevocable_perpetual_license", "perpetual-license@1.0.0"),
    ("source_code_escrow", "escrow-clause@1.0.0"),
    ("post_termination_services", "post-termination@1.0.0"),
    ("audit_rights", "audit-clause@1.0.0"),
    ("uncapped_liability", "liability-uncapped@1.0.0"),
    ("cap_on_liability", "liability-cap@1.0.0"),
    ("liquidated_damages", "liquidated-damages@1.0.0"),
    ("warranty_duration", "warranty-clause@1.0.0"),
    ("insurance", "insurance-clause@1.0.0"),
    ("covenant_not_to_sue", "covenant-clause@1.0.0"),
    ("third_party_beneficiary", "third-party@1.0.0"),
]

# Template priority per clause type; anything else is "unknown".
PRIORITY_ORDER = ["essential", "high", "medium", "low", "unknown"]
TEMPLATE_PRIORITIES = {
    "essential": ["document_name", "parties", "agreement_date", "effective_date", "governing_law"],
    "high": [
        "expiration_date", "renewal_term", "notice_period_renewal", "termination_convenience", "non_compete",
        "exclusivity", "revenue_profit_sharing", "price_restrictions", "minimum_commitment",
        "ip_ownership_assignment", "license_grant", "uncapped_liability", "cap_on_liability", "liquidated_damages",
    ],
    "medium": [
        "most_favored_nation", "no_solicit_customers", "competitive_restriction_exception", "no_solicit_employees",
        "non_disparagement", "right_of_first_refusal", "change_of_control", "anti_assignment", "volume_restriction",
        "joint_ip_ownership", "non_transferable_license", "affiliate_license_licensor",
        "affiliate_license_licensee", "unlimited_license", "irrevocable_perpetual_license", "source_code_escrow",
        "post_termination_services", "audit_rights", "warranty_duration", "insurance", "covenant_not_to_sue",
    ],
    "low": ["third_party_beneficiary"],
}
# The alternate priority table used when graph template nodes are
# built without a priority lookup; every other type is "medium".
GRAPH_PRIORITIES = {
    "essential": ["parties", "governing_law", "effective_date", "expiration_date"],
    "high": ["termination_convenience", "revenue_profit_sharing", "liability"],
}

# Clause presence rules and template coverage floor.
REQUIRED_CLAUSES = ["parties"]
RECOMMENDED_CLAUSES = ["governing_law", "agreement_date"]
MIN_TEMPLATE_COVERAGE = 0.1

# Lifecycle flow, categories and gates.
STANDARD_FLOW = [
    ("draft", ["under_review"]),
    ("under_review", ["approved", "draft"]),
    ("approved", ["signed", "draft"]),
    ("signed", ["effective"]),
    ("effective", ["active"]),
    ("active", ["renewal_notice_period", "termination_notice_period", "in_breach", "suspended", "expired"]),
    ("renewal_notice_period", ["renewing", "termination_notice_period"]),
    ("renewing", ["active"]),
    ("termination_notice_period", ["terminating"]),
    ("terminating", ["terminated"]),
    ("in_breach", ["cure_period", "terminating"]),
    ("cure_period", ["active", "terminating"]),
    ("suspended", ["active", "terminating"]),
    ("terminated", ["post_termination_obligations"]),
    ("expired", ["post_termination_obligations"]),
    ("post_termination_obligations", []),
]
DEFAULT_TRANSITIONS = [
    ("draft", "under_review"),
    ("under_review", "approved"),
    ("approved", "signed"),
    ("signed", "effective"),
    ("effective", "active"),
    ("active", "terminated"),
    ("active", "expired"),
    ("active", "renewal_notice_period"),
    ("renewal_notice_period", "active"),
    ("terminated", "post_termination_obligations"),
]
CATEGORY_STEMS = [
    ("formation", ["draft", "review", "negotiat", "approv", "sign"]),
    ("operational", ["effective", "active", "perform", "execut", "operational"]),
    ("modification", ["amend", "renew", "suspend", "modif", "chang"]),
    ("termination", ["terminat", "expir", "end", "complet", "final"]),
]
DEFAULT_CATEGORY = "operational"
TERMINAL_WORDS = [
    "terminated", "expired", "completed", "finished", "ended",
    "post_termination", "final", "closed", "concluded",
]
TRIGGER_STEMS = ["sign", "execute", "terminate", "expire", "renew", "activate", "effective"]
INITIAL_CANDIDATES = ["draft", "signed", "effective", "active"]
FORBIDDEN_CATEGORY_MOVES = [("termination", "formation"), ("termination", "operational")]
CONTEXT_FIRST_TYPES = [
    "effective_date", "expiration_date", "agreement_date",
    "termination_convenience", "renewal_term", "notice_period_renewal",
]
QUALITY_GATE = {"minimum_reachability": 0.8, "maximum_warnings": 5, "minimum_confidence": 0.5}
REQUIRED_STATES = ["draft", "active", "terminated"]
MINIMUM_TRANSITIONS = 3
CONFIDENCE_BANDS = [("high", 0.8), ("medium", 0.6), ("low", 0.4)]
QUALITY_BANDS = [("excellent", 0.9), ("good", 0.7), ("acceptable", 0.5)]
QUALITY_WEIGHTS = {
    "state_confidence": 0.3, "transition_confidence": 0.2,
    "fsm_validation": 0.3, "business_logic": 0.2,
}

# Graph naming.
TITLE_PRIORITY_TYPES = [
    "license_grant", "non_compete", "revenue_profit_sharing", "termination_convenience",
    "governing_law", "parties", "effective_date",
]
ENTITY_TYPE_WORDS = [
    ("corporation", ["corp", "inc", "incorporated", "company", "co"]),
    ("llc", ["llc", "l.l.c"]),
    ("partnership", ["partnership", "llp", "l.l.p"]),
    ("individual", ["individual", "person"]),
]
PARTY_ROLES = ["client", "vendor", "licensor", "licensee", "buyer", "seller", "other"]


def schema_rows() -> list[tuple[str, str, str, int]]:
    """(clause_type, var_name, var_type, pos) for every schema variable."""
    rows = []
    for clause_type, spec in VARIABLE_SCHEMA:
        for pos, (name, var_type) in enumerate(spec):
            rows.append((clause_type, name, var_type, pos))
    return rows


def deniers(clause_type: str, var_name: str) -> list[str]:
    """The ``hasX`` variables of the same clause whose false value clears this variable."""
    if var_name.startswith("has"):
        return []
    return [name for kind, name, _, _ in schema_rows()
            if kind == clause_type and name.startswith("has") and name[3:].lower() in var_name.lower()]


def type_positions() -> dict[str, int]:
    return {clause_type: i for i, (clause_type, _) in enumerate(VARIABLE_SCHEMA)}


def priority_rows() -> list[tuple[str, str, int]]:
    return [
        (clause_type, priority, PRIORITY_ORDER.index(priority))
        for priority, types in TEMPLATE_PRIORITIES.items()
        for clause_type in types
    ]


def flow_rows() -> list[tuple[str, str]]:
    return [(source, target) for source, targets in STANDARD_FLOW for target in targets]


def schema_frame(spark: SparkSession) -> DataFrame:
    rows = [(*row, deniers(row[0], row[1])) for row in schema_rows()]
    return spark.createDataFrame(
        rows, "clause_type string, var_name string, var_type string, pos int, deniers array<string>")


def template_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATE_MAP, "clause_type string, template string")


def priority_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        priority_rows(), "clause_type string, priority string, priority_rank int")


def sql_values(rows, columns: str) -> str:
    """An inline SQL relation with the given rows, for the oracle side."""
    def lit(v):
        return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS lookup({columns})"
