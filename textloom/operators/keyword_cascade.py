"""Cascades over word lists: Hindi packs by first list that has a word, Chinese packs by how many words of a list there are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.cascade import any_of, cascade, hits
from textloom.schema import NEEDS_REVIEW

# Words of the Hindi cascade, by label in the order in which they are tried.
HI_FRAUD = (
    "won", "winner", "claim award", "lottery", "congratulations won", "number won", "number selected", "chevron", "coca cola prize", "yahoo lottery", "msn lottery", "hot diamond", "british diamond", "free car", "selected 650,000",
    "selected 700,000", "selected 365,000", "selected 500,000", "contact claim", "email claim", "claim contact", "claim email", "ur number chosen", "prize call rs", "/sms win rs", "rs /sms win", "cocacolaclaim", "msndept22",
    "chevroinoil74", "britishdiamond", "cocacolaprize", "ticket to thailand", "extended till", "qualifiars", "6.50lac", "wfp", "what your number", "get15grams", "15grams silver", "won mobile", "won phone", "won laptop", "won bike", "won car", "won trip", "won cash", "won gold",
    "won silver", "won diamond", "won watch", "won voucher", "prize worth", "cash prize", "prize winner",
    "lucky draw winner", "lucky winner", "congratulations! you are lucky", "congratulations!u have won", "congratulations! you have won", "congratulations! u have won", "congratulations on winning", "you have been awarded",
    "you have been selected", "your number has won", "your mobile number won", "your number has been awarded", "your number has been selected", "your mobile number has won", "your mobile number has been awarded",
    "your mobile number has been selected",
)
HI_INTERACTIVE = r"reply within 24|reply.*24 hrs|reply.*24 hours|blyk|aircel.*free|all your replies.*free|all your interactions.*free|all your.*free.*blyk"
HI_TRANSACTION = (
    "pnr", "train detail", "pnr status", "policy due", "premium due", "bill due", "request timed out", "code=", "tid=", "please complete registration", "settings delivered", "mobile office active", "recharge alert", "validity expired",
    "data card expired", "thanks for being a valued member", "thanks for being a member", "thanks for your support", "activate 3g", "3g activate", "Mobile Office active", "settings successfully", "thanks for being", "thanks for your", "you are enjoying", "pack expires", "you have been charged", "service has been activated", "info call 121", "dial 121",
    "balance information", "*121#", "*122*", "*123*5#",
)
HI_HARASS = (
    "work from home", "earn per day", "earn daily", "earn per month", "earn from home", "income per day", "income per month", "per month income", "part time income", "full time income", "rs. 15000", "rs. 30000", "rs 15000", "rs 30000",
    "mobile/laptop repairing", "hi-tech se", "per month", "per day", "daily income", "monthly income", "work from home earn", "work from home&earn", "work from home & earn", "cyberjob", "cyber job", "160by2", "160by2.com", "sent 4rm", "sent from", "sent by", "send your resume", "email your resume", "homejobsindya",
    "home jobs", "work at home", "earn extra income", "business opportunity", "no investment", "free joining", "free training", "natural aloe vera", "bee honey", "network marketing", "mlm", "franchise opportunity",
    "rs. 15000/ se rs. 30000/", "rs 15000/ se rs 30000/",
)

# Reasons of each label, the words of which decide. A list in a list: one of its words as well.
HI_REASONS = {
    "FRAUD": (
        ((("won", "winner"),), "假中奖诈骗，声称用户已中奖"), ((("lottery", "prize"),), "虚假抽奖/奖品诈骗"), ((("selected",), ("cash", "award", "prize")), "虚假中奖，要求联系领取奖金"), ((("chevron", "coca cola", "yahoo", "msn"),), "虚假公司名义中奖诈骗"),
        ((("free car",),), "虚假免费汽车/房产诱惑"), ((("ticket to thailand", "trip to thailand"),), "虚假旅游奖品诱导"), ((("what your number",),), '虚假"你的号码"竞赛诈骗'), ((("get15grams", "15grams"),), "虚假银币奖励诱导"), ((), "虚假中奖/奖品诈骗"),
    ),
    "TRANSACTION": (
        ((("pnr", "train"),), "PNR/列车信息查询服务"), ((("policy", "premium"),), "保险保费到期通知"), ((("bill",),), "账单到期通知"), ((("request timed out", "code="),), "服务请求超时/系统通知"), ((("settings", "mobile office"),), "移动办公设置激活通知"),
        ((("recharge alert", "validity"),), "充值/有效期到期提醒"), ((("thanks",), ("member", "support")), "Blyk会员感谢消息"), ((("activate", "3g"),), "3G激活/服务通知"), ((("balance", "*121#", "*123*"),), "账户余额/信息查询指引"),
        ((("dial 121", "info call"),), "客服信息查询指引"), ((("you are enjoying", "pack expires"),), "套餐到期提醒"), ((("you have been charged",),), "扣费通知"), ((("service has been activated",),), "服务激活确认"), ((), "业务通知/服务消息"),
    ),
    "HARASS": (
        ((("reply within 24", "blyk", "aircel"),), "Blyk互动问答/骚扰式推销"), ((("work from home", "earn"),), "高薪诱惑/在家工作诈骗"), ((("160by2", "cyberjob"),), "代发短信/网络兼职骚扰"), ((("sent 4rm", "sent from"),), "代发短信骚扰"),
        ((("business opportunity", "franchise"),), "商业机会/加盟骚扰"), ((("no investment", "free joining"),), "零投资加盟诱惑"), ((("natural aloe vera", "bee honey"),), "微商/保健品推销骚扰"), ((("income",), ("month", "day")), "高薪收入诱惑"),
        ((("per month", "per day"),), "高薪诱惑"), ((("rs. 15000", "rs. 30000", "rs 15000", "rs 30000"),), "高薪课程/工作诱惑"), ((("mobile/laptop", "hi-tech"),), "高薪维修课程诱惑"), ((("home jobs", "work at home"),), "在家工作诱惑"),
        ((("send your resume", "email your resume"),), "简历收集骚扰"), ((), "骚扰式推销/灰产"),
    ),
    "AD": (
        ((("talktime", "recharge", "full talktime"),), "充值/话费优惠促销"), ((("bhk", "flat", "plot", "apartment"),), "房产广告"), ((("snapdeal", "easemytrip"),), "电商/旅游促销"), ((("discount", "% off", "% discount"),), "折扣促销广告"),
        ((("course", "admission", "training"),), "教育/课程招生广告"), ((("hiring", "walk", "interview"),), "招聘广告"), ((("loan", "emi", "insurance"),), "贷款/保险广告"), ((("health", "treatment", "doctor"),), "医疗/健康服务广告"),
        ((("holiday", "trip", "travel"),), "旅游/度假套餐广告"), ((("food", "restaurant", "pizza"),), "餐饮/食品促销"), ((("movie", "music", "game"),), "娱乐/内容服务广告"), ((("data card", "3g", "internet"),), "数据卡/网络服务广告"),
        ((("caller tune", "ringtone"),), "彩铃/音乐服务广告"), ((("offer", "deal", "sale"),), "促销/优惠活动广告"), ((("free", "gift"),), "免费/赠品促销"), ((("book", "buy", "shop"),), "购物/预订广告"), ((("call now", "sms now"),), "即时行动促销广告"),
        ((("limited", "hurry", "rush"),), "限时促销广告"), ((("new", "latest"),), "新品/新款广告"), ((("collection", "fashion"),), "时尚/服装广告"), ((("property", "realty", "developer"),), "房产/开发商广告"), ((("service", "repair"),), "维修服务广告"),
        ((("bank", "credit card"),), "银行/信用卡广告"), ((("contest", "competition"),), "竞赛/活动广告"), ((("win",), ("mobile", "phone", "laptop", "bike", "car", "trip", "cash", "gold", "silver", "watch", "voucher")), "有奖活动促销"),
        ((("sms",), ("win", "prize")), "短信抽奖促销"), ((), "商业促销广告"),
    ),
    NEEDS_REVIEW: (((), "内容不确定，需人工审核"),),
}

#: Words that make a text advertising unless another list comes first; a longer list is a parameter of ``keyword_hi``.
HI_AD = tuple(dict.fromkeys(w for groups, _ in HI_REASONS["AD"] if len(groups) == 1 for w in groups[0]))


def keyword_hi(rows: DataFrame, overrides: DataFrame | None = None, ad_words: Sequence[str] = HI_AD) -> DataFrame:
    """``rows`` (id, text, ...) with label and reason: the first list that has a word of the text, else review.

    ``overrides`` (id, label) go over the lists; the reason is always that of the final label.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    cases = [(any_of(low, HI_FRAUD), "FRAUD", ""), (low.rlike(f"(?d){HI_INTERACTIVE}"), "HARASS", ""), (any_of(low, HI_TRANSACTION), "TRANSACTION", ""), (any_of(low, HI_HARASS), "HARASS", ""), (any_of(low, ad_words), "AD", "")]
    out = rows.withColumn("label", cascade(cases, (NEEDS_REVIEW, ""))["label"])
    if overrides is not None:
        given = overrides.groupBy("id").agg(F.max("label").alias("_given"))
        out = out.join(given, "id", "left").withColumn("label", F.coalesce("_given", "label")).drop("_given")
    reason = F.lit("")
    for label, cases in HI_REASONS.items():
        said = [(_every(low, groups), label, text) for groups, text in cases]
        reason = F.when(F.col("label") == label, cascade(said, ("", ""))["reason"]).otherwise(reason)
    return out.withColumn("reason", reason)


def _every(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    out = F.lit(True)
    for words in groups:
        out = out & any_of(text, words)
    return out


# Words of the Chinese cascade. They are looked for as they stand: a dot or star is no pattern.
ZH_FRAUD = ("涉嫌诈骗", "涉嫌恶意透支", "冻结支付账户", "法院传票", "拘捕令", "涉嫌洗钱", "包裹涉毒", "社保异常", "逮捕令")
ZH_HARASS = (
    "严重逾期", "恶意透支", "强制执行", "起诉", "法庭", "律师函", "上报征信", "列入失信", "冻结账户", "划扣工资", "联系单位", "户籍地", "催收", "催缴", "逾期记录", "报送人行", "征信系统", "不良信用", "默认拒偿", "永不减免", "申请司法", "诉讼", "开庭",
    "最后期限", "否则将", "后果自负", "采取.*措施", "查封.*冻结", "拒不还款",
)
ZH_HARASS_3 = (*ZH_HARASS, "诉前告知", "移交司法", "申请.*强制执行", "仲裁委", "仲裁", "欠款.*公开", "催缴流程")
ZH_GOVERNMENT = (
    "中国残联", "助残日", "共青团", "12355", "公益热线", "防汛", "抗旱", "气象预警", "教育部", "整治.*办学", "严禁提前开学", "存款保险", "全国科技工作者日", "科协", "防汛抗旱指挥部", "铁路安全", "电力公司", "国网", "气象服务", "手机气象",
    "公益短信", "廉洁", "纪检", "纪委监委",
)
ZH_GOVERNMENT_PROMO = ("权益", "会员", "流量包", "优惠", "红包", "福利", "活动")
ZH_EXPRESS = ("取件码", "凭.*领取", "运单尾号", "包裹.*派送", "韵达", "顺丰", "中通", "圆通", "极兔", "京东配送", "菜鸟驿站", "丰巢", "妈妈驿站", "已到.*取件", "派送上门", "请.*取件", "包裹.*已到")
ZH_EXPRESS_3 = (*ZH_EXPRESS, "代收点")
ZH_EXPRESS_PROMO = ("贷款", "额度", "借款", "审核", "权益", "会员")
ZH_OPERATOR = (
    "流量.*使用", "语音.*使用", "余额", "话费", "套餐", "月租", "充值", "消费", "积分.*领取", "权益.*领取", "月卡权益", "日包", "月包", "流量包", "语音包", "叠加包", "流量.*到账", "语音.*到账", "电子券.*到账", "流量.*使用完", "语音.*使用完",
    "余额不足", "扣费", "代交", "代扣", "充值成功", "交费", "查询服务", "服务评价", "满意度", "余额变动", "话费余额", "账户余额", "自动充值", "自动充", "中国移动", "中国联通", "中国电信", "流量超套", "流量用尽", "语音用尽", "业务办理", "确认办理",
)
ZH_OPERATOR_3 = (
    "流量.*使用", "语音.*使用", "余额", "话费", "套餐", "月租", "充值", "消费", "积分.*领取", "权益.*领取", "日包", "月包", "流量包", "语音包", "叠加包", "流量.*到账", "语音.*到账", "电子券.*到账", "流量.*使用完", "语音.*使用完", "流量用尽",
    "语音用尽", "余额不足", "扣费", "代交", "代扣", "充值成功", "交费", "查询服务", "服务评价", "满意度", "余额变动", "话费余额", "账户余额", "自动充值", "自动充", "流量超套", "流量.*提醒", "业务办理", "确认办理", "服务.*提醒", "中国移动",
    "中国联通", "中国电信", "未接来电", "遇忙未接", "拒接主叫", "来电提醒", "验证码", "验证码为", "安全验证", "登录验证",
)
ZH_BANK = (
    "还款", "扣款", "到账", "账单", "提现", "还款成功", "还款失败", "信用卡", "银行", "借呗", "花呗", "本期账单", "未还", "已还", "尾号", "卡号", "消费提醒", "支出提醒", "收入提醒", "退款", "返现", "返还", "到账通知", "信用卡还款", "账单已结清",
    "本期.*已还", "支付宝", "微信支付", "京东支付", "自动还款", "扣款成功", "扣款失败",
)
ZH_BANK_3 = (*ZH_BANK, "代扣.*成功", "消费.*元", "支出.*元", "收入.*元")
ZH_INSURANCE = ("投保", "保单", "保险", "理赔", "续保", "车险")
ZH_INSURANCE_3 = (*ZH_INSURANCE, "入账提醒")
ZH_VEHICLE = ("车险", "车辆", "车主.*授权", "车牌")
ZH_WORK = ("施工", "派单", "跳纤", "网元", "告警", "工单", "检修")
ZH_WORK_3 = (*ZH_WORK, "派送.*单", "售后单", "服务单")
ZH_WEATHER = ("今晚到明天", "明晚到后天", "多云", "晴", "雨", "气温", "风力", "湿度", "摄氏度", "度")
ZH_WEATHER_3 = ("今晚到明天", "明晚到后天", "多云", "晴", "气温", "风力", "湿度", "摄氏度", "度")
ZH_SURVEY = ("满意度", "服务评价", "评价.*抽奖", "评价.*参与", "调研", "满意度调查", "请您评价", "诚邀.*评价")
ZH_SURVEY_PRIZE = ("抽奖", "赢", "礼品", "话费券", "激励")
ZH_LOAN = (
    "借款.*已", "额度.*已", "贷款.*已", "预授信", "预放", "预审", "消费额", "信用贷", "激活.*额度", "查看.*额度", "领取.*额度", r"\d+元.*已", "预汇入", "预转入", r"成功.*\d+元", r"预放.*\d+", r"审核通过.*\d+", r"预批.*\d+", "循环可支用", "待激活",
    "待提款", "待提取", "额度待激活", "可支用.*元", r"预估.*\d+万", r"预估.*\d+元", r"特批.*\d+", r"放宽.*\d+",
)
ZH_LOAN_3 = (*ZH_LOAN, "预进入.*元", "预汇入.*元")
ZH_AD = (
    "贷款", "额度", "借款", "点击.*领取", "点击.*查看", "点击.*查询", "点击.*参与", "拒收请回复R", "拒收请回复 R", "会员", "权益", "优惠", "红包", "福利", "限时", "免费领取", "免费", "特价", "恭喜.*获得", "预授信", "预批", "特批", "放宽", "咨询电话",
    "客服电话", r"详询.*\d{3,}", "http", "点击.*报名", "点击.*确认", "点击.*激活", "点击.*提取", "点击.*参与", "报名.*活动", "赢取.*大奖", "赢取.*话费", "赢取.*礼品",
)
ZH_AD_3 = (*ZH_AD, "立减", "折上折", "预售", "上市", "新品")
ZH_MEDICAL = ("筛查", "普查", "补助", "援助", "申请.*回", "白癜风", "银屑病", "胎记", "癫痫", "了解详情", "申请检查", "惠民", "公益普查")
ZH_EDUCATION = ("课程", "培训", "资料已发", "教程已发", "不点.*失效", "速领", "涨分资料", "剪辑推广", "变现教程", "学习资料")
ZH_CARRIERS = ("中国移动", "中国联通", "中国电信")
ZH_MARKETING = ("权益", "会员", "优惠", "红包", "福利", "限时", "免费领取", "恭喜.*获得", "点击.*领取", "点击.*参与", "抽奖", "赢取", "活动.*开启", "活动.*上线", "嘉年华", "礼遇")
ZH_PRODUCT = ("预售", "上市", "新品", "抢购", "秒杀", "特惠", "折扣", "满减", "立减", "折上折")

# Patterns of the Chinese cascade.
ZH_COLLECTION = (r"合同逾期.*全款偿还", r"分期资格.*取消", r"强制执行.*查封", r"催缴.*公开", r"联系.*亲属", r"仲裁.*诉讼", r"提交.*仲裁", r"申请.*仲裁")
ZH_COLLECTION_3 = (r"合同逾期.*全款偿还", r"分期资格.*取消", r"强制执行.*查封", r"催缴.*公开", r"联系.*亲属", r"提交.*仲裁", r"申请.*仲裁", r"诉前告知", r"最后.*还款", r"立即还款", r"拒不.*处理")
ZH_AMOUNTS = (
    r"还款.*\d+\.?\d*元", r"到账.*\d+\.?\d*元", r"余额.*\d+\.?\d*元", r"账单.*\d+\.?\d*元", r"消费.*\d+\.?\d*元", r"充值.*\d+\.?\d*元", r"尾号[\p{L}\p{N}_]+.*\d+\.?\d*元", r"验证码.*\d{4,8}", r"\d+\.?\d*元.*还款",
    r"取件码.*[\p{L}\p{N}_]+", r"凭[\p{L}\p{N}_]+.*领取", r"\d+\.?\d*元.*到账", r"\d+\.?\d*元.*消费",
)
ZH_AMOUNTS_3 = (*ZH_AMOUNTS, r"支出\s*\d+\.?\d*元", r"收入\s*\d+\.?\d*元")


def counts_zh(text: Column, variant: int = 3) -> Column:
    """struct(label, confidence, rationale) of Chinese texts by how many words of a list they have; ``variant`` 2 or 3.

    The third asks for fewer signs of harassment and of a carrier's service, and looks at insurance and vehicles first.
    """
    third = variant == 3
    t = F.coalesce(text, F.lit(""))

    def said(words: Sequence[str]) -> Column:
        return any_of(t, words)

    def like(patterns: Sequence[str]) -> Column:
        return t.rlike("(?d)" + "|".join(patterns))

    operator, bank = hits(t, ZH_OPERATOR_3 if third else ZH_OPERATOR), hits(t, ZH_BANK_3 if third else ZH_BANK)
    amount, ads = like(ZH_AMOUNTS_3 if third else ZH_AMOUNTS), hits(t, ZH_AD_3 if third else ZH_AD)
    government, survey = said(ZH_GOVERNMENT), said(ZH_SURVEY)
    insured = [(said(ZH_INSURANCE_3), "TRANSACTION", "高", "保险/金融服务通知"), (said(ZH_VEHICLE), "TRANSACTION", "中", "车辆服务通知")]
    first = [
        (F.regexp_replace(t, r"\s+", "") == "", NEEDS_REVIEW, "低", "短信内容为空"),
        (said(ZH_FRAUD), "FRAUD", "高", "包含诈骗关键词"),
        (hits(t, ZH_HARASS_3) >= 1, "HARASS", "高", "包含催收/威胁关键词") if third else (hits(t, ZH_HARASS) >= 2, "HARASS", "高", "包含多个催收/威胁关键词"),
        (like(ZH_COLLECTION_3 if third else ZH_COLLECTION), "HARASS", "高", "匹配催收模式"),
    ]
    services = [
        (government & ~said(ZH_GOVERNMENT_PROMO), NEEDS_REVIEW, "高", "政府/公益/公共服务信息，无商业推广"),
        (said(ZH_EXPRESS_3 if third else ZH_EXPRESS) & ~said(ZH_EXPRESS_PROMO), "TRANSACTION", "高", "快递/物流服务通知"),
        (amount & (operator + bank >= 2), "TRANSACTION", "高", "包含明确的交易信息（金额/账单/到账/验证码）"),
        (operator >= 2, "TRANSACTION", "高", "运营商服务通知（流量/余额/账单/来电提醒）") if third else (operator >= 3, "TRANSACTION", "高", "运营商服务通知（流量/余额/账单）"),
        ((bank >= 2) & amount, "TRANSACTION", "高", "银行/金融交易通知"),
    ]
    rest = [
        (said(ZH_WORK_3 if third else ZH_WORK), NEEDS_REVIEW, "中", "工作/业务通知，需人工判断"),
        (said(ZH_WEATHER_3 if third else ZH_WEATHER) & (F.length(t) < 200), NEEDS_REVIEW, "高", "天气预报服务信息"),
        (survey & said(ZH_SURVEY_PRIZE), "AD", "中", "服务评价邀请，含营销激励（抽奖/礼品）"),
        (survey, NEEDS_REVIEW, "中", "服务评价邀请，边界模糊"),
        (said(ZH_LOAN_3 if third else ZH_LOAN), "AD", "高", "贷款产品推广广告"),
        (said(ZH_MEDICAL), "AD", "中", "医疗推广信息"),
        (said(ZH_EDUCATION), "AD", "中", "教育培训推广"),
        (said(ZH_CARRIERS) & said(ZH_MARKETING), "AD", "中", "运营商营销推广"),
        (said(ZH_PRODUCT) & (ads >= 2), "AD", "高", "产品营销广告"),
        (ads >= 3, "AD", "高", "包含多个广告特征"),
        (government, NEEDS_REVIEW, "高", "政府/公益信息"),
        (operator + bank >= 1, "TRANSACTION", "中", "疑似交易/服务通知，需人工确认"),
    ]
    if third:
        cases = [*first, *insured, *services, *rest]
    else:
        cases = [*first, *services, (said(ZH_INSURANCE), "TRANSACTION", "高", "保险服务通知"), *rest]
    out = None
    for when, label, confidence, why in cases:
        value = F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"), F.lit(why).alias("rationale"))
        out = F.when(when, value) if out is None else out.when(when, value)
    return out.otherwise(F.struct(F.lit(NEEDS_REVIEW).alias("label"), F.lit("低").alias("confidence"), F.lit("无法明确归类，需人工判断").alias("rationale")))


# The label of bad messages, words of services that show such a label to be wrong, and what is said then.
ZH_BLACK = "黑短信"
ZH_SERVICE = ("快递", "包裹", "取件", "验证码", "还款", "账单", "到账")
ZH_MISLABELLED = "原标签为黑短信但内容为正常服务: "


def counts_zh_of(rows: DataFrame, text: str, original: str, *keep: str, variant: int = 3) -> DataFrame:
    """(*keep, label, confidence, rationale) by ``counts_zh``; where a text of a service was labelled as bad before and isn't so by
    its words, the rationale says that. The struct passes a generator, so the plan holds its conditions once.
    """
    found = rows.select(*keep, F.col(text).alias("_text"), F.col(original).alias("_original"), F.inline(F.array(counts_zh(F.col(text), variant))))
    wrong = (F.col("_original") == ZH_BLACK) & any_of(F.coalesce("_text", F.lit("")), ZH_SERVICE) & F.col("label").isin("TRANSACTION", NEEDS_REVIEW)
    why = F.when(wrong, F.concat(F.lit(ZH_MISLABELLED), "rationale")).otherwise(F.col("rationale"))
    return found.select(*keep, "label", "confidence", why.alias("rationale"))
