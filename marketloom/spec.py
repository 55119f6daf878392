"""Fixed values that decide results: constants, word lists, patterns and labels.

Everything here is data. Queries bind these values as literals or as small broadcast tables.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values: momentum -------------------------------------------------------------------
RPS_WINDOWS = (20, 50, 120, 250)
RPS_SELF_WINDOW = 120
RPS_PREFIXES = ("60", "68", "00", "30", "20")
RPS_MARKETS = ("sh", "sz")
SIGNAL_MIN_SESSIONS = 121
MA_WINDOWS = (5, 10, 20, 50, 120)


@dataclass(frozen=True)
class SignalRule:
    """Thresholds of one momentum strategy."""

    strategy: str
    label: str
    base: dict[int, float]
    volume_factor: float
    volume_name: str


# ---- fixed values: strategies -----------------------------------------------------------------
STANDARD_LAUNCH = SignalRule("rps_standard_launch", "RPS标准", {250: 80, 120: 85, 50: 88, 20: 92}, 1.3, "volume_start")
ATTACK = SignalRule("rps_attack", "RPS进攻", {250: 75, 120: 80, 50: 82, 20: 88}, 1.2, "volume_mild_expand")

# ---- fixed values: financial score ------------------------------------------------------------
# (sub indicator, dimension, higher is better, values <= 0 are penalised)
SUB_INDICATORS = (
    ("roe_ex", "profitability", True, True),
    ("net_margin", "profitability", True, True),
    ("roe_pct", "profitability", True, True),
    ("revenue_growth", "growth", True, False),
    ("profit_growth", "growth", True, False),
    ("ex_profit_growth", "growth", True, False),
    ("ar_days", "operating", False, True),
    ("inv_days", "operating", False, True),
    ("asset_turn", "operating", True, True),
    ("ocf_to_profit", "cashflow", True, True),
    ("ocf_to_rev", "cashflow", True, True),
    ("free_cf", "cashflow", True, True),
    ("debt_ratio", "solvency", False, True),
    ("current_ratio", "solvency", True, True),
    ("quick_ratio", "solvency", True, True),
    ("ar_to_asset", "asset_quality", False, False),
    ("inv_to_asset", "asset_quality", False, False),
    ("goodwill_ratio", "asset_quality", False, False),
    ("impair_to_rev", "asset_quality", False, False),
)
SUB_KEYS = tuple(row[0] for row in SUB_INDICATORS)
DIM_WEIGHTS = {
    "profitability": 0.25,
    "growth": 0.20,
    "operating": 0.15,
    "cashflow": 0.20,
    "solvency": 0.10,
    "asset_quality": 0.10,
}
BLENDED_DIMS = ("operating", "solvency", "asset_quality")
BLEND_INDUSTRY_SHARE = 0.7
BLEND_MARKET_SHARE = 0.3
FINANCIAL_SECTORS = ("银行", "非银金融")
FINANCIAL_SUPPRESSED = (
    "current_ratio", "quick_ratio", "ar_days", "inv_days", "ar_to_asset", "inv_to_asset", "asset_turn",
)

# ---- fixed values: statement column titles ----------------------------------------------------
STATEMENT_TITLES = {
    "revenue": "营业收入",
    "net_profit": "归属于母公司所有者的净利润",
    "ex_net_profit": "扣除非经常性损益后的净利润",
    "op_cf": "经营活动产生的现金流量净额",
    "capex": "购建固定资产、无形资产和其他长期资产支付的现金",
    "total_assets": "资产总计",
    "total_debt": "负债合计",
    "equity": "归属于母公司股东权益(资产负债表)",
    "ar": "应收账款",
    "inventory": "存货",
    "goodwill": "商誉",
    "impair_loss": "资产减值损失",
    "op_cost": "营业成本",
    "op_profit": "营业利润",
    "current_assets": "流动资产合计",
    "current_liab": "流动负债合计",
    "net_margin": "净利润率(非金融类指标)",
    "roe_pct": "净资产收益率",
    "revenue_growth": "营业收入增长率(%)",
    "profit_growth": "净利润增长率(%)",
    "ex_profit_growth": "扣非净利润同比(%)",
    "ar_days": "应收帐款周转天数(非金融类指标)",
    "inv_days": "存货周转天数(非金融类指标)",
    "asset_turn": "总资产周转率(非金融类指标)",
    "ocf_to_rev": "经营活动产生的现金流量净额/营业收入",
    "debt_ratio": "资产负债率(%)",
    "current_ratio": "流动比率(非金融类指标)",
    "quick_ratio": "速动比率(非金融类指标)",
    "gross_margin_pct": "销售毛利率(%)",
    "eps": "基本每股收益",
    "eps_single": "基本每股收益（单季度）",
    "eps_diluted": "稀释每股收益(元)",
    "total_shares": "总股本",
    "paid_in_capital": "实收资本（或股本）",
    "free_float_shares": "自由流通股(股)",
    "listed_a_shares": "已上市流通A股",
    "listed_b_shares": "已上市流通B股",
    "listed_h_shares": "已上市流通H股",
    "bvps": "每股净资产",
    "bvps_adjusted": "每股净资产(调整后)",
}

# ---- fixed values: diagnostics ----------------------------------------------------------------
# (sub indicator, label, template, component columns, unit suffix, lower is better)
DIAGNOSTICS = (
    ("roe_ex", "扣非ROE", "formula_decomposition", "ex_net_profit,equity", "%", False),
    ("net_margin", "净利率", "formula_decomposition", "net_profit,revenue", "%", False),
    ("roe_pct", "净资产收益率", "direct_field_signal", "net_profit,equity", "%", False),
    ("revenue_growth", "营收增速", "period_compare", "revenue", "%", False),
    ("profit_growth", "净利润增速", "period_compare", "net_profit", "%", False),
    ("ex_profit_growth", "扣非增速", "period_compare", "ex_net_profit", "%", False),
    ("ar_days", "应收周转天数", "efficiency_misalignment", "ar,revenue", "", True),
    ("inv_days", "存货周转天数", "efficiency_misalignment", "inventory,op_cost", "", True),
    ("asset_turn", "总资产周转率", "efficiency_misalignment", "revenue,total_assets", "", False),
    ("ocf_to_profit", "净现比", "formula_decomposition", "op_cf,net_profit", "", False),
    ("ocf_to_rev", "现金流/营收", "formula_decomposition", "op_cf,revenue", "", False),
    ("free_cf", "自由现金流", "formula_decomposition", "op_cf,capex", "", False),
    ("debt_ratio", "资产负债率", "efficiency_misalignment", "total_debt,total_assets", "%", True),
    ("current_ratio", "流动比率", "efficiency_misalignment", "current_assets,current_liab", "", False),
    ("quick_ratio", "速动比率", "efficiency_misalignment", "current_assets,inventory,current_liab", "", False),
    ("ar_to_asset", "应收占比", "formula_decomposition", "ar,total_assets", "%", True),
    ("inv_to_asset", "存货占比", "formula_decomposition", "inventory,total_assets", "%", True),
    ("goodwill_ratio", "商誉占比", "formula_decomposition", "goodwill,total_assets", "%", True),
    ("impair_to_rev", "减值损失率", "formula_decomposition", "impair_loss,revenue", "%", True),
)
EVIDENCE = {  # template -> (strength, needs text validation)
    "formula_decomposition": ("high", False),
    "efficiency_misalignment": ("medium", True),
    "period_compare": ("medium", True),
    "direct_field_signal": ("low", True),
}
# (sub indicator, component, sensitivity, label, rising word, falling word)
DRIVERS = (
    ("roe_ex", "ex_net_profit", 1, "扣非利润", "抬升", "回落"),
    ("roe_ex", "equity", -1, "归母权益", "抬升", "回落"),
    ("ocf_to_profit", "op_cf", 1, "经营现金流", "抬升", "回落"),
    ("ocf_to_profit", "net_profit", -1, "净利润", "抬升", "回落"),
    ("net_margin", "net_profit", 1, "净利润", "抬升", "回落"),
    ("net_margin", "revenue", -1, "营收", "抬升", "回落"),
    ("ocf_to_rev", "op_cf", 1, "经营现金流", "抬升", "回落"),
    ("ocf_to_rev", "revenue", -1, "营收", "抬升", "回落"),
    ("free_cf", "op_cf", 1, "经营现金流", "抬升", "回落"),
    ("free_cf", "capex", -1, "资本开支", "扩张", "收缩"),
    ("ar_to_asset", "ar", 1, "应收账款", "抬升", "回落"),
    ("ar_to_asset", "total_assets", -1, "总资产", "抬升", "回落"),
    ("inv_to_asset", "inventory", 1, "存货", "抬升", "回落"),
    ("inv_to_asset", "total_assets", -1, "总资产", "抬升", "回落"),
    ("goodwill_ratio", "goodwill", 1, "商誉", "抬升", "回落"),
    ("goodwill_ratio", "total_assets", -1, "总资产", "抬升", "回落"),
    ("impair_to_rev", "impair_loss", 1, "减值损失", "抬升", "回落"),
    ("impair_to_rev", "revenue", -1, "营收", "抬升", "回落"),
    ("debt_ratio", "total_debt", 1, "负债规模", "抬升", "回落"),
    ("debt_ratio", "total_assets", -1, "总资产", "抬升", "回落"),
    ("ar_days", "ar", 1, "应收账款", "抬升", "回落"),
    ("ar_days", "revenue", -1, "营收", "抬升", "回落"),
    ("inv_days", "inventory", 1, "存货", "抬升", "回落"),
    ("inv_days", "op_cost", -1, "营业成本", "抬升", "回落"),
    ("asset_turn", "revenue", 1, "营收", "抬升", "回落"),
    ("asset_turn", "total_assets", -1, "总资产", "抬升", "回落"),
    ("current_ratio", "current_assets", 1, "流动资产", "抬升", "回落"),
    ("current_ratio", "current_liab", -1, "流动负债", "抬升", "回落"),
    ("quick_ratio", "current_assets", 1, "流动资产", "抬升", "回落"),
    ("quick_ratio", "current_liab", -1, "流动负债", "抬升", "回落"),
    ("quick_ratio", "inventory", -1, "存货", "抬升", "回落"),
)
DRIVER_FLAT = "基本持平"
DRIVER_FALLBACKS = {"main": "暂无更强主因信号", "secondary": "暂无更强同向次因", "hedge": "暂无明显对冲项"}

# ---- fixed values: valuation ------------------------------------------------------------------
NEW_LISTING_SESSIONS = 60
MIN_VALID_MEMBERS = 10
PE_THRESHOLD_MULTIPLIER = 5.0
PE_THRESHOLD_FLOOR = 50.0
PE_THRESHOLD_CAP = 200.0
HISTORY_SINCE_YEAR = 2022
CLASS_LABELS = {
    "A_NORMAL_EARNING": "A类 正常盈利",
    "B_THIN_PROFIT_DISTORTED": "B类 微盈利畸高",
    "C_LOSS": "C类 亏损经营",
    "D": "D类 高风险例外",
}
PERCENTILE_BANDS = ((20.0, "低估区间"), (40.0, "合理偏低"), (60.0, "合理"), (80.0, "合理偏高"), (None, "高估区间"))
TEMPERATURE_BANDS = ((30.0, "行业偏冷"), (70.0, "行业温和"), (80.0, "行业偏热"), (None, "行业过热"))
HOT_TEMPERATURES = ("行业偏热", "行业过热")
LABEL_NEW_LISTING = "次新股"
LABEL_SMALL_SAMPLE = "样本不足"
LABEL_NOT_COMPARABLE = "估值不可比"
NOTE_PS_FALLBACK = "PE invalid, fallback to PS percentile"
RISK_NEW_LISTING = "上市未满60个交易日"
RISK_HIGH_PERCENTILE = "80%以上分位风险非线性上升"
RISK_HOT_INDUSTRY = "行业环境偏热/过热"

# ---- fixed values: intraday screener ----------------------------------------------------------
LIMIT_UP_PCT = 9.8
LOT_SIZE = 100.0
TAIL_SESSION = {
    "gain_min_pct": 3.0,
    "gain_max_pct": 5.0,
    "limit_up_lookback_days": 20,
    "min_volume_ratio": 1.4,
    "max_market_cap_yi": 200.0,
    "turnover_min_pct": 5.0,
    "turnover_max_pct": 10.0,
    "intraday_above_vwap": True,
    "intraday_above_vwap_min_ratio_pct": 80.0,
    "intraday_vwap_max_breach_pct": 0.3,
    "current_above_open": True,
}
TAIL_SESSION_NAMES = {  # switch -> shown condition names
    "gain_pct": ("涨幅",),
    "limit_up_lookback_days": ("涨停基因",),
    "min_volume_ratio": ("量比",),
    "max_market_cap_yi": ("市值",),
    "turnover_pct": ("换手率",),
    "intraday_above_vwap": ("全天在均价线上方", "大部分时间在均价线上方"),
    "current_above_open": ("当前价高于开盘价",),
}
WINDOW_SPECS = (("open_15m_volume", "09:31", "09:45"), ("window_1430_1445_volume", "14:30", "14:45"))
TRUE_WORDS = ("1", "true", "yes", "y", "passed", "命中")

# ---- fixed values: concept rules --------------------------------------------------------------
CONCEPT_RULE_VERSION = "concept_filter_rules_v1"
CONCEPT_ID_SOURCE = "tdx_local"
CONCEPT_DEFAULT = ("default_keep_core", "core", "keep_core")
HIDE = "hide_from_default_ui"
# (rule id, priority, bucket, match type, patterns)
CONCEPT_RULES = (
    ("drop_empty", 10, "empty", "exact", ("无", "个人")),
    ("drop_historical_alias", 20, "alias", "contains", ("<-",)),
    ("drop_business_description", 30, "description", "regex_any", ("[；;]",)),
    ("drop_business_description_fragment", 31, "description", "regex_any", (
        r"^(?=[^;；]{8,}$)(?=.*[、，,]).*的(?:生产|销售|技术研发|研发)(?:[、，,及与和].*)?$",
        r"^(?=[^;；]{8,}$)(?=.*[、，,]).*(?:等资源)?的(?:勘探开采|勘探|开采)(?:[、，,及与和].*)?$",
    )),
    ("drop_business_portrait_fragment", 32, "description", "regex_any", (
        r"^全球排名前[一二三四五六七八九十0-9]+的.+生产商(?:及.+生产商)?$",
        r"^[^,，；;]{2,}贸易$",
        r"^火力及新能源发电等$",
    )),
    ("drop_date_prefix", 40, "timestamped", "regex_any", (r"^(19|20|21|22|23|24|25|26)\d{4}\s*",)),
    ("drop_financial_report", 50, "financial", "regex_any", (
        "评级", "目标价", "综合评级", "营业收入", "净利润", "扣非", "每股收益", "一季报", "中报", "三季报", "年报",
        "半年报", "业绩预亏", "业绩预增", "业绩公告预警", "财报亏损",
    )),
    ("drop_financial_numeric_fragment", 55, "financial", "regex_any", (
        r"^(同比|环比|增长|下降|增幅|降幅)\s*-?\d+(?:\.\d+)?%[.。]?$",
    )),
    ("drop_shareholder_ratio_fragment", 58, "shareholder", "regex_any", (
        r"^占(?:总股本比例|总股本|流通股比例|流通股本比例)?\s*\d+(?:\.\d+)?%[.。]?$",
        r"^[^()（）%]{2,}(?:\(|（)\d+(?:\.\d+)?%(?:\)|）)$",
    )),
    ("drop_holding_unlock", 60, "shareholder", "regex_any", (
        "解禁", "增持", "减持", "持股", "万股", "亿股", "保险持股", "知名投行持股", "高盛持股",
    )),
    ("drop_technical", 70, "technical", "regex_any", (
        "上穿", "下穿", "BOLL", "MACD", "KDJ", "RSI", "CCI", "多头排列", "平台整理", "金叉", "死叉", "超卖", "超买",
        "底背离",
    )),
    ("drop_membership_style", 80, "membership", "regex_any", (
        "罗素", "转板A股", "注册制", "融资融券", "沪股通", "深股通",
    )),
)

# ---- fixed values: industry tags --------------------------------------------------------------
INDUSTRY_TAGS = (
    ("nonbank_finance", ("保险", "非银金融", "证券", "多元金融")),
    ("bank", ("银行", "全国性银行", "地方性银行")),
    ("materials_resources", ("工业金属", "有色", "钢铁", "建材", "化工", "石油", "煤炭")),
    ("industrial_metal", ("工业金属", "有色")),
    ("consumer", ("食品饮料", "酿酒", "商贸", "轻工制造", "家电", "纺织服饰", "社会服务", "消费")),
    ("pharma", ("医药医疗", "医药生物", "化学制药", "中药", "生物制品", "医疗服务", "医疗器械")),
    ("tech_media", ("电子", "半导体", "计算机", "通信", "传媒")),
    ("semiconductor", ("半导体", "消费电子")),
    ("cyclical_manufacturing", ("机械设备", "工程机械", "通用设备", "专用设备", "电力设备", "汽车", "国防军工", "建筑", "交通运输")),
    ("utilities_env", ("公用事业", "环保")),
    ("agriculture", ("农林牧渔", "养殖业", "种植业")),
    ("real_estate", ("房地产", "房地产开发", "房产服务")),
    ("composite", ("综合", "综合类")),
)

# ---- fixed values: archive --------------------------------------------------------------------
REQUIRED_DATASETS = (
    "bars_15m",
    "features_intraday_volume_windows",
    "dataset_stock_candidate_pool",
    "dataset_stock_industry_current",
    "dataset_stock_rps_current",
    "dataset_concept_dictionary",
    "dataset_stock_concept_current",
    "snapshot_market_overview",
    "snapshot_stock_industry_membership",
    "snapshot_stock_rps_current",
    "snapshot_stock_concept_membership",
)
# ---- fixed values: execution grades -----------------------------------------------------------
GRADE_ACTION = {"S": "core", "A": "standard", "B": "probe", "C": "observe"}
ACTION_CAP_PCT = {"core": 100.0, "standard": 100.0, "probe": 25.0, "observe": 0.0, "avoid": 0.0}
ACTION_LADDER = ("core", "standard", "probe", "observe", "avoid")
# ---- fixed values: fixed-width security master ------------------------------------------------
MASTER_HEADER = 50
MASTER_RECORD = 360
MASTER_NAME = (31, 18, "gbk")
MASTER_INITIALS = (329, 12, "ascii")
# ---- fixed values: exchange by code prefix -----------------------------------------------------
# Prefix tables: first hit wins. ``None`` as the last entry is the default exchange.
MARKET_PREFIXES = {
    "default": (("sh", ("6", "5")), ("bj", ("92", "4", "8")), ("sz", None)),
    "warehouse": (("sh", ("6", "5")), ("bj", ("92",)), ("sz", None)),
    "single_day": (("sh", ("6",)), ("bj", ("92",)), ("sz", None)),
    "strict": (("sh", ("60", "68", "90")), ("sz", ("00", "30", "20"))),
    "wide": (("sh", ("6", "5", "9")), ("sz", ("0", "3")), ("bj", ("4", "8"))),
}
# ---- fixed values: request parameters of the screener -------------------------------------------
TEXT_PARAMS = {
    "industry_level_1": "industry_level_1", "industry_level_2": "industry_level_2",
    "industry_temperature_label": "industry_temperature_label", "classification": "classification", "valuation_band": "valuation_band_label",
}
NUMBER_PARAMS = {
    "min_total_score": ("market_total_score", "min"), "min_ind_total_score": ("industry_total_score", "min"),
    "max_market_rank": ("market_total_rank", "max"), "max_industry_rank": ("industry_total_rank", "max"),
    "min_primary_percentile": ("primary_percentile", "min"), "max_primary_percentile": ("primary_percentile", "max"),
    "min_current_price": ("current_price", "min"), "max_current_price": ("current_price", "max"),
}
