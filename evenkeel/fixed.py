"""Fixed values of the data convention: table names, column lists and formulas.

They must equal the convention's own names for results to be right, and are stated
here plainly and in their natural order.
"""

# --- table groups per preset -------------------------------------------------------------
PERSON = ("person_1", "person_2")
PREVIOUS = ("applprev_1", "applprev_2")
TAX = ("tax_registry_a_1", "tax_registry_b_1", "tax_registry_c_1")
CARDS = ("debitcard_1", "deposit_1")
BUREAU_B = ("credit_bureau_b_1", "credit_bureau_b_2")
PAYMENTS = "credit_bureau_a_2"

# --- columns of the large groups ---------------------------------------------------------
LARGE_COLUMNS = {
    "credit_bureau_a_1": (
        "dpdmax_139P", "dpdmax_757P", "dpdmaxdateyear_596T", "overdueamountmax_155A",
        "overdueamountmax_35A", "numberofoverdueinstlmax_1151L", "numberofoverdueinstlmax_1039L",
        "numberofinstls_320L", "numberofinstls_229L", "residualamount_856A", "residualamount_488A",
        "totaloutstanddebtvalue_39A", "totaloutstanddebtvalue_668A", "debtoutstand_525A", "debtoverdue_47A",
    ),
    "credit_bureau_a_2": (
        "pmts_dpd_1073P", "pmts_dpd_303P", "pmts_overdue_1140A", "pmts_overdue_1152A",
        "pmts_month_158T", "pmts_month_706T", "pmts_year_1139T", "pmts_year_507T",
    ),
}

# Roles of the payment columns, once for running and once for ended contracts.
PAYMENT_SIDES = {
    "active": {
        "dpd": "pmts_dpd_1073P", "overdue": "pmts_overdue_1140A",
        "month": "pmts_month_158T", "year": "pmts_year_1139T",
    },
    "closed": {
        "dpd": "pmts_dpd_303P", "overdue": "pmts_overdue_1152A",
        "month": "pmts_month_706T", "year": "pmts_year_507T",
    },
}
DPD_LIMITS = (0, 30, 60, 90)

# --- columns named by the table-specific policies ----------------------------------------
BUREAU_EXTRA = (
    "annualeffectiverate_199L", "annualeffectiverate_63L", "contractsum_5085717L", "credlmt_230A",
    "credlmt_935A", "nominalrate_281L", "nominalrate_498L", "numberofcontrsvalue_258L",
    "numberofcontrsvalue_358L", "numberofinstls_229L", "numberofinstls_320L",
    "numberofoutstandinstls_520L", "numberofoutstandinstls_59L", "numberofoverdueinstlmax_1039L",
    "numberofoverdueinstlmax_1151L", "numberofoverdueinstls_725L", "numberofoverdueinstls_834L",
)
PERSON_FIRST = (
    "empl_employedtotal_800L", "empl_employedfrom_271D", "empl_industry_691L", "familystate_447L",
    "incometype_1044T", "sex_738L", "housetype_905L", "housingtype_772L", "isreference_387L", "birth_259D",
)
PERSON_INCOME = "mainoccupationinc_384A"
PERSON_INCOME_TYPE = "incometype_1044T"
SELF_EMPLOYED = "SELFEMPLOYED"
EMPLOYER_COLUMNS = ("empls_economicalst_849M", "empls_employedfrom_796D", "empls_employer_name_740M")
TAX_AMOUNT = "amount_4527230A"
GAP_COLUMNS = ("collater_valueofguarantee_1124L", "pmts_dpd_1073P", "pmts_overdue_1140A")
REFRESH_DATE = "refreshdate_3813885D"

# --- ratio features: (output, numerator, denominator) ------------------------------------
RATIOS = (
    ("annuity_to_credamount", "annuity_780A", "credamount_770A"),
    ("next_annuity_to_annuity", "annuitynextmonth_57A", "annuity_780A"),
    ("currdebt_to_credamount", "currdebt_22A", "credamount_770A"),
    ("disbursed_to_credamount", "disbursedcredamount_1113A", "credamount_770A"),
    ("downpmt_to_credamount", "downpmt_116A", "credamount_770A"),
    ("maxannuity_to_annuity", "maxannuity_159A", "annuity_780A"),
    ("lastappr_to_credamount", "lastapprcredamount_781A", "credamount_770A"),
    ("lastreject_to_credamount", "lastrejectcredamount_222A", "credamount_770A"),
    ("avgpmt_to_annuity", "avgpmtlast12m_4525200A", "annuity_780A"),
    ("avgoutstand_to_credamount", "avgoutstandbalancel6m_4187114A", "credamount_770A"),
    ("bureau_overdue_to_outstanding_max",
     "credit_bureau_a_1__overdueamount_31A__max", "credit_bureau_a_1__outstandingamount_354A__max"),
    ("bureau_overdue2_to_outstanding2_max",
     "credit_bureau_a_1__overdueamount_659A__max", "credit_bureau_a_1__outstandingamount_362A__max"),
    ("prev_annuity_mean_to_current", "applprev_1__annuity_853A__mean", "annuity_780A"),
    ("prev_credamount_mean_to_current", "applprev_1__credamount_590A__mean", "credamount_770A"),
)

# --- columns whose max - min range is kept by the stable range component -------------------
STABLE_RANGES = (
    "credit_bureau_a_1__numberofoverdueinstlmax_1151L", "credit_bureau_a_1__lastupdate_388D",
    "credit_bureau_a_1__dateofrealrepmt_138D", "credit_bureau_a_1__dpdmax_757P",
    "credit_bureau_a_1__overdueamountmaxdateyear_994T", "credit_bureau_a_1__dpdmaxdateyear_896T",
    "credit_bureau_a_1__dateofcredend_353D", "credit_bureau_a_1__dateofcredstart_181D",
    "credit_bureau_a_1__nominalrate_498L", "credit_bureau_a_1__totalamount_6A",
    "credit_bureau_a_1__overdueamountmax_35A", "credit_bureau_a_1__numberofinstls_229L",
    "credit_bureau_a_1__overdueamountmax2_398A", "credit_bureau_a_1__dpdmax_139P",
    "credit_bureau_a_1__overdueamountmax_155A", "credit_bureau_a_1__numberofoverdueinstlmax_1039L",
    "credit_bureau_a_1__overdueamountmax2_14A", "tax_registry_c_1__pmtamount_36A",
    "credit_bureau_a_1__dpdmaxdatemonth_442T", "credit_bureau_a_1__overdueamountmaxdatemonth_284T",
    "credit_bureau_a_1__monthlyinstlamount_674A", "applprev_1__maxdpdtolerance_577P",
    "credit_bureau_a_1__numberofoverdueinstlmaxdat_148D",
)
RANGE_WORDS = ("amount", "debt", "dpd", "annuity", "cred")

# --- column sets behind the bureau summary features ---------------------------------------
BUREAU_DPD = ("dpdmax_139P", "dpdmax_757P")
BUREAU_OVERDUE_INSTALMENTS = (
    "numberofoverdueinstlmax_1039L", "numberofoverdueinstlmax_1151L",
    "numberofoverdueinstls_725L", "numberofoverdueinstls_834L",
)
BUREAU_OVERDUE_AMOUNTS = (
    "overdueamountmax_155A", "overdueamountmax_35A", "overdueamountmax2_14A", "overdueamountmax2_398A",
    "overdueamount_31A", "overdueamount_659A", "debtoverdue_47A",
)
BUREAU_OUTSTANDING = (
    "outstandingamount_354A", "outstandingamount_362A", "totaloutstanddebtvalue_39A",
    "totaloutstanddebtvalue_668A", "debtoutstand_525A", "residualamount_488A", "residualamount_856A",
)
BUREAU_LIMITS = ("credlmt_230A", "credlmt_935A")
BUREAU_TOTALS = ("totalamount_6A", "totalamount_996A", "contractsum_5085717L")
BUREAU_UPDATES = ("lastupdate_388D", "lastupdate_1112D")
BUREAU_STARTS = ("dateofcredstart_181D", "dateofcredstart_739D")

# --- feature-set components ---------------------------------------------------------------
COMPONENTS = (
    "missing", "counts", "ratios", "ranges", "ranges_stable", "last",
    "a2_twostage", "a2_delinquency", "a2_delinquency_stable", "a2_payment_mix", "a2_temporal",
    "a2_dpd30_contract",
    "table_custom_aggs", "custom_person_aggs", "custom_person_narrow_aggs",
    "custom_deposit_debitcard_aggs", "custom_bureau_a1_aggs", "custom_bureau_a1_narrow_aggs",
    "custom_applprev_aggs", "custom_applprev_narrow_aggs", "custom_tax_aggs", "custom_tax_narrow_aggs",
    "custom_bureau_b_narrow_aggs", "custom_other_aggs",
    "ex2_data", "semantic_v2", "semantic_v2_stable", "sota_lgb_644", "sota_cat_661",
)

# --- ablation groups ----------------------------------------------------------------------
ABLATION_TABLES = {
    "drop_credit_bureau_a_1": ("credit_bureau_a_1__",),
    "drop_credit_bureau_a_2": ("credit_bureau_a_2__",),
    "drop_applprev_1": ("applprev_1__",),
    "drop_tax_all": tuple(f"{t}__" for t in TAX),
    "drop_person_all": ("person_1__", "person_2__"),
    "drop_deposit_debitcard": ("deposit_1__", "debitcard_1__"),
    "drop_small_external": (*(f"{t}__" for t in TAX), "deposit_1__", "debitcard_1__"),
}
ABLATION_AGGS = {
    "drop_sum": ("sum",),
    "drop_std": ("std",),
    "drop_median": ("median",),
    "drop_first_last": ("first", "last"),
    "drop_sum_std": ("sum", "std"),
    "drop_count": ("count",),
}

# --- week restoration ---------------------------------------------------------------------
RESTORE_ANCHOR_DAY = 17899  # 2019-01-03
WEEK_ORIGIN_DAY = 17897  # 2019-01-01
