"""Label repair for Indonesian, Hindi and Chinese packs, and the review of Chinese advertising: label in, label out.

Each function gives struct(label, reason), with a null label where nothing changes. Texts are matched in lower case; a dot in a
pattern ends at a line feed only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.cascade import any_of, change, changed_rows
from textloom.schema import NEEDS_REVIEW

# Words and patterns of the Indonesian repair.
ID_PRIZE = ("pemenang", "pin pemenang", "pin:", "kode pin", "grandprize", "gebyar", "toyota", "all new yaris", "blogspot", "undian bri", "cek di: bit.ly")
ID_GIFT = ("mobil", "rp.175", "rp175", "milyar", "klaim", "info hadiah")
ID_BANK = r"(rek|rekening|transfer).{0,40}(bri|bca|mandiri|bni)"
ID_SEND = ("kirim", "transfer", "uang")
ID_CREDIT = r"(isi\s*(dl\s*)?pulsa|krim plsa|kirim pulsa)"
ID_ACCOUNT = ("08", "rek", "rekening")
ID_CARRIER_DRAW = ("indosat", "telkomsel", "xl axiata", "tri ")
ID_POINTS = ("poin", "kupon")
ID_FALSE_DRAW = ("blogspot", "pin:", "toyota", "yaris", "pin pemenang")
ID_PHONES = ("blackberry", "bb dakota", "bb onyx", "bb torch", "bb gemini", "bb z10", "iphone", "samsung", "laptop")
ID_NUMBER = r"08\d{8,}"
ID_CHEAP = ("disc", "diskon", "discon", "promo", "big sale", "jt", "rb", "murah")
ID_TELCO = ("telkomsel", "indosat", "mytelkomsel", "axis", "xl ", "[xl]")
ID_LOAN = ("pinjaman", "pinjmn", "dana tunai", "kta", "tanpa agunan", "bpkb", "bunga")
ID_TOGEL = ("togel", "angka jitu", "sgp edisi")
ID_DUKUN = ("dukun", "santet", "pelet", "pesugihan")
ID_ADULT = ("seks", "bokep", "dewasa", "vcs")
ID_PROMO = ("paket flash", "kuota", "bronet", "iring", "rbt", "mytelkomsel", "aktifkan", "*123*", "*808*", "grabcar", "grabtaxi", "diskon")
ID_RESULT = ("berhasil diaktifkan", "berhasil.", "isi ulang", "topup", "sisa kuota", "sudah di non-aktifkan", "telah aktif", "kode transaksi", "orderan sedang kami proses")
ID_CALL = ("promo", "spesial untuk", "yuks", "ayo")
ID_DONE = ("berhasil diaktifkan", "isi ulang", "topup", "sisa kuota flash anda", "sudah di non-aktifkan", "kode transaksi")

# Words and patterns of the Hindi repair.
HI_QUIZ = r"(who (won|do you|is)|which (team|player)|how many|can you guess|want to know|want a sample|\^1/|\^yes|reply within|option [123]|1\) |2\) |3\))"
HI_PRIZE = (
    r"(your number (has )?won|has been awarded|is selected for|winner!\s*\d|claim your prize|cash prize|\d{3,},\d{3}\s*(gbp|pounds|\$)|lottery held|intl draw|coca-?cola.*/?uk|hot diamond|yahoo/?msn lottery)"
)
HI_LUCK = ("won", "claim", "voucher", "pearl set", "lucky winner")
HI_LURE = ("claim", "absolutely free", "pearl", "cash", "gbp", "pounds")
HI_RECHARGE = (
    r"(full talktime|ke recharge|recharge (par|pe|mein|now|with)|talktime (validity|ki validity)|best (full )?talktime|recharge alert|stvs? to con|dial karein \*121|best offer janiye"
    r"|airtel 3g.*(watch|play|games|tv channels)|get train details|send and receive money instantly|hello tune|football-barclays|go to http://m\.google)"
)
HI_RESULT = (
    "service has been activated", "settings have been successfully delivered", "mms settings have been successfully", "mobile office is active", "mobile office & mms is active", "please complete registration process",
    "request timed out", "indian railways servers are very busy",
)
HI_CODE = r"\botp\b|verification code|a/c credited|debited|txn id"
HI_ADULT = ("get laid", "sexy", "call girl", "xxx", "dating service", "adult")
HI_JOB = r"(sms sending job|earn rs\.?\s*\d+|work from home).{0,40}(call|www)"
HI_TRIP = ("ticket to thailand", "trip to thailand", "pack ur bag")
HI_STAKE = ("600000", "3lac", "wfp", "qualfiars")

# Words and patterns of the review of Chinese advertising.
ZH_MOBILE = r"(?<!\d)(1[3-9]\d{9})(?!\d)"
ZH_WIDE, ZH_NARROW = "０１２３４５６７８９　", "0123456789 "
ZH_BANKS = ("邮储银行", "平安银行", "兴业银行", "招商银行", "中国银行", "工商银行", "建设银行", "农业银行", "交通银行", "中信银行", "光大银行", "民生银行", "浦发银行", "华夏银行", "广发银行", "【平安银行】", "【招商银行】", "【中国银行】")
ZH_CARRIERS = ("中国移动", "中国联通", "中国电信", "杭州移动", "【移动】", "【联通】", "【电信】")
ZH_BRANDS = ("【天猫】", "【京东】", "【大众点评】", "【小米】", "【红牛", "世纪佳缘", "无线城市")
ZH_PROPERTY = ("可正常贷款", "可贷款", "不限购", "淘宝贷款", "天猫贷款", "购车", "楼盘", "别墅", "公寓", "商铺", "售楼", "永久产权", "首付", "看房", "现房", "房产投资", "澳洲房产", "新加坡")
ZH_BANK_CARD = ("新一贷", "随兴贷", "邮储银行", "信用卡", "办卡")
ZH_BANK_LOAN = ("房产抵押", "消费贷款", "授信")
ZH_BROKER = ("当天放款", "当天下款", "无抵押", "免担保", "下款快")
ZH_PHISHING = ("安全账户", "账户异常", "洗钱", "提供密码", "告知验证码", "把验证码", "转账到安全")
ZH_OFFICE = ("公安", "检察院", "法院传", "刑事")
ZH_PRIZE = ("恭喜您中奖", "您已中奖", "中奖通知", "领取奖金", "立即兑奖", "点击领奖", "免费领取iPhone", "0元领iPhone", "中大奖")
ZH_TRUE_DRAW = ("双色球", "不保证中奖", "大众点评", "红牛", "中福在线")
ZH_COLLECT = ("领奖", "兑奖")
ZH_LINK = r"https?://|wap\.|[\p{L}\p{N}_]+\.(cn|com)/[\p{L}\p{N}_]+"
ZH_KNOWN_LINK = ("中福在线", "红牛", "无线城市", "中国移动", "139邮箱")
ZH_BOOKED = r"您账户\d+于.*(扣款|入账|消费|支出|存入)"
ZH_CODE = r"(验证码是|验证码为|动态码|校验码是|短信验证码)[：:\s]*\d{4,8}"
ZH_PASS_ON = ("转发验证码", "告诉别人", "提供给")
ZH_PARCEL = ("取件码", "快递已到达", "已到达驿站", "待取件", "丰巢")
ZH_PARCEL_PROMO = ("优惠", "促销", "办卡", "充值送")
ZH_INVOICE = ("代开发票", "发票代开", "发票均可代开", "有发票可向外代开")
ZH_ADULT = ("莞式", "包夜", "特殊服务", "出台服务", "技师上门", "裸聊", "一夜情", "全套上门")
ZH_GAMBLING = ("娱乐城", "百家乐", "六合彩", "时时彩", "真人荷官", "开户即送", "送彩金", "扎金花", "澳门赌场")
ZH_BET = ("投注", "自选回")
ZH_STOCKS = ("带学员", "带客买入", "带客建", "锁仓金股", "明日必涨", "内线", "冲高出货", "尾盘买入")
ZH_FUNDS, ZH_FUND_TALK = ("私募基金", "私募"), ("必涨", "带学员", "金股", "拉停", "建仓")
ZH_PARTNER, ZH_PARTNER_TALK = ("合作前期无费用", "前期无费用", "诚寻好项目"), ("资金", "合作")
ZH_PAPERS = ("代办证", "假证", "办假证", "真实驾驶证", "代办各院校")
ZH_PAPER_KINDS = ("发票", "营业执照", "资格证", "驾驶证", "大专", "大本")
ZH_LOAN = ("无抵押", "免担保", "当天放款", "当天下款", "3天放款", "日放款", "下款快", "放款快", "小额贷款", "信用贷", "信用贷款", "抵押贷款", "二次贷款", "装修贷款", "大额无抵", "信用岱歀")
ZH_HARD_LOAN = ("无抵押", "免担保", "当天放款", "当天下款", "小额贷款", "下款快", "放款快", "3天放款", "日放款", "信用岱歀", "链家金融")
ZH_SOFT_LOAN = ("贷款", "放款", "下款", "抵押", "信用贷")
ZH_CHAT = ("飞信好友", "【发自飞信】", "希望加您为飞信")
ZH_BROKER_NEWS = ("财富早间版", "财富收盘版", "财富版：")
ZH_MARKET = ("投资建议", "仅供参考", "仓位", "指数", "股指", "减仓", "逢高")
ZH_DAILY = ("财富", "收盘", "早间")
ZH_FRAGMENTS = ("2.最新活动", "VIP6 贵宾客户-专享活动特权")
ZH_PHONE_ONLY = r"^\[手机电话\]:\s*\+?\d+$"
ZH_SHORT = ("优惠", "验证码", "中奖")
SEVERITY = ("FRAUD", "TRANSACTION", "HARASS", "NEEDS_REVIEW")


def _found(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?d){pattern}")


def repair_id(text: Column, label: Column) -> Column:
    """Indonesian: every rule may change a row; of the changes of a row the last one holds.

    So the rules are tried from the last to the first, and the first that changes the label decides.
    """
    low = F.lower(text)
    prize = any_of(low, ID_PRIZE) | F.contains(low, F.lit("hadiah")) & any_of(low, ID_GIFT)
    bank = _found(low, ID_BANK) & any_of(low, ID_SEND)
    credit = _found(low, ID_CREDIT) & any_of(low, ID_ACCOUNT)
    true_draw = any_of(low, ID_CARRIER_DRAW) & any_of(low, ID_POINTS) & ~any_of(low, ID_FALSE_DRAW)
    phones, cheap = any_of(low, ID_PHONES), any_of(low, ID_CHEAP)
    personal = _found(text, ID_NUMBER) | F.contains(low, F.lit("pin bb"))
    loan, togel, dukun = any_of(low, ID_LOAN) & personal, any_of(low, ID_TOGEL), any_of(low, ID_DUKUN)
    promo = any_of(low, ID_PROMO) & ~prize & ~(phones & personal)
    result = any_of(low, ID_RESULT)
    review, transaction = label == NEEDS_REVIEW, label == "TRANSACTION"
    in_order = [
        ((prize | bank | credit) & ~true_draw, "FRAUD", "假中奖/要转账/要充值诈骗"),
        (phones & personal & cheap & ~any_of(low, ID_TELCO), "FRAUD", "私人号超低价电子产品灰产/疑似诈骗店"),
        ((loan | togel | dukun | any_of(low, ID_ADULT)) & ~prize, "HARASS", "灰产贷款/赌博/成人/巫术骚扰"),
        ((label == "FRAUD") & promo & ~bank, "AD", "运营商/正规促销误标诈骗"),
        (transaction & phones & personal, "FRAUD", "事务误标的灰产手机店"),
        (transaction & prize, "FRAUD", "事务误标的假中奖"),
        (transaction & loan & ~result, "HARASS", "事务误标的贷款推销"),
        ((label == "AD") & result & ~any_of(low, ID_CALL) & any_of(low, ID_DONE), "TRANSACTION", "业务结果通知误标广告"),
        (review & ~(prize | phones & personal & cheap) & (loan | togel | dukun), "HARASS", "REVIEW漏标骚扰"),
        (review & (prize | phones & personal & cheap), "FRAUD", "REVIEW漏标诈骗"),
    ]
    return change([(when & (label != new), new, reason) for when, new, reason in reversed(in_order)], label)


def _hi_signs(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    congratulated = F.contains(low, F.lit("ongratulations"))
    return {
        "prize": _found(low, HI_PRIZE) | congratulated & any_of(low, HI_LUCK) & any_of(low, HI_LURE), "quiz": _found(low, HI_QUIZ), "adult": any_of(low, HI_ADULT), "job": _found(low, HI_JOB),
        "result": F.contains(low, F.lit("indian railways")) & F.contains(low, F.lit("pnr")) | any_of(low, HI_RESULT) | _found(low, HI_CODE), "recharge": _found(low, HI_RECHARGE),
    }


def repair_hi(text: Column, label: Column) -> Column:
    """Hindi: the first sign that holds decides, also where it leaves the label as it is."""
    low, s = F.lower(text), _hi_signs(text)

    def said(*words: str) -> Column:
        out = F.lit(True)
        for w in words:
            out = out & F.contains(low, F.lit(w))
        return out

    fraud = label == "FRAUD"
    cases = [
        (s["prize"], "FRAUD", "假中奖/彩票认领诈骗"),
        (s["quiz"] & s["adult"], "HARASS", "问答/竞猜增值短信，非诈骗"),
        (s["quiz"], "AD", "问答/竞猜增值短信，非诈骗"),
        (s["adult"] | s["job"], "HARASS", "成人/灰产兼职骚扰"),
        (s["result"], "TRANSACTION", "业务结果/系统激活/PNR等事务通知"),
        (said("receive money through mobile banking") | said("provide mobile no", "mmid"), "TRANSACTION", "网银/手机银行收款说明"),
        (s["recharge"] & label.isin("TRANSACTION", "FRAUD", "HARASS", NEEDS_REVIEW), "AD", "充值套餐/增值服务促销"),
        (s["recharge"], "", ""),
        (said("open an account with federal bank"), "AD", "银行开户促销"),
        (said("win a hong kong trip", "hyundai"), "AD", "车商活动抽奖促销"),
        ((said("had won mobile phone") | said("winning an ipod")) & said("dial") & fraud, "AD", "增值抽奖拨号促销(非经典转账诈骗)"),
        (said("had won mobile phone") | said("winning an ipod"), "", ""),
        (said("ecovillage") & fraud, "AD", "房产促销话术"),
        (said("http://m.google.co.in") & (F.length(text) < 80), NEEDS_REVIEW, "残缺链接无法判断"),
        (any_of(low, HI_TRIP) & any_of(low, HI_STAKE), "FRAUD", "高门槛旅游抽奖/传销式诱导"),
        (said("send ur email id"), "FRAUD", "索要邮箱/联系方式可疑"),
    ]
    return change(cases, label)


def repair_hi_second(text: Column, label: Column) -> Column:
    """The second Hindi pass, over the labels of the first: quizzes that are still harassment are advertising."""
    s = _hi_signs(text)
    return change([((label == "HARASS") & s["quiz"] & ~s["adult"] & ~s["job"], "AD", "体育/娱乐问答增值促销")], label)


def unify_zh(text: Column, label: Column) -> Column:
    """Chinese lottery texts: tips and calls to bet are harassment, results of a bought ticket are transactions.

    Goes over every other correction: give it a higher priority (120) than those of rules (100) and agents.
    """
    lottery, tips = F.contains(text, F.lit("双色球")), F.contains(text, F.lit("专家推荐"))
    cases = [
        (lottery & (tips | F.contains(text, F.lit("自选回"))), "HARASS", "双色球荐号/投注博彩招揽统一HARASS"),
        (lottery & F.contains(text, F.lit("已中奖")) & ~tips, "TRANSACTION", "已购彩票中奖结果通知"),
    ]
    return change(cases, label)


def review_ad_zh(text: Column) -> Column:
    """Chinese advertising looked at again: the label that the text should have had, null if it stays advertising."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    digits = F.translate(t, ZH_WIDE, ZH_NARROW)
    n = F.regexp_replace(digits, r"[\s/]+", "")

    def said(*words: str) -> Column:
        return any_of(t, words)

    def close(*words: str) -> Column:
        return any_of(n, words)

    official = any_of(t, ZH_BANKS) & (any_of(t, ZH_BANK_CARD) | any_of(t, ZH_BANK_LOAN) & ~any_of(t, ZH_BROKER))
    lending = any_of(n, ZH_LOAN) & ~any_of(t, ZH_PROPERTY) & ~official
    cases = [
        (t == "", NEEDS_REVIEW, "空文本无法判断"),
        (close(*ZH_PHISHING) & ~said("法院对面"), "FRAUD", "钓鱼/冒充或索要验证码密码"),
        (said("涉嫌") & said(*ZH_OFFICE), "FRAUD", "假公检法恐吓话术"),
        (close(*ZH_PRIZE) & ~said(*ZH_TRUE_DRAW, *ZH_BRANDS, *ZH_CARRIERS, *ZH_BANKS), "FRAUD", "假中奖/诱导领奖"),
        (close(*ZH_COLLECT) & t.rlike(f"(?i){ZH_LINK}") & ~said(*ZH_BRANDS, *ZH_CARRIERS, *ZH_BANKS, *ZH_KNOWN_LINK), "FRAUD", "不明短链领奖诱导"),
        (_found(digits, ZH_BOOKED), "TRANSACTION", "账户扣款/入账等业务结果告知（主意图）"),
        (_found(digits, ZH_CODE) & ~said(*ZH_PASS_ON), "TRANSACTION", "纯验证码事务短信"),
        (close(*ZH_PARCEL) & ~said(*ZH_PARCEL_PROMO), "TRANSACTION", "物流取件事务告知"),
        (close("代开") & close("发票") | close(*ZH_INVOICE), "HARASS", "代开发票灰产招揽"),
        (close(*ZH_ADULT), "HARASS", "成人/色情服务招揽"),
        (close(*ZH_GAMBLING), "HARASS", "赌博/博彩招揽"),
        (close("双色球") & close("专家推荐") & close(*ZH_BET), "HARASS", "彩票投注招揽（专家荐号诱导投注）"),
        (close(*ZH_STOCKS) | close(*ZH_FUNDS) & close(*ZH_FUND_TALK), "HARASS", "荐股带客灰产硬推销"),
        (close(*ZH_PARTNER) & close(*ZH_PARTNER_TALK), "HARASS", "资金中介/灰产合作招揽"),
        (close(*ZH_PAPERS) | close("代办") & close(*ZH_PAPER_KINDS), "HARASS", "代办证件/学历灰产"),
        (lending & (close(*ZH_HARD_LOAN) | n.rlike(ZH_MOBILE) & close(*ZH_SOFT_LOAN)), "HARASS", "无抵押/当天放款/私人中介硬推销贷款"),
        (said("冲浪助手"), NEEDS_REVIEW, "纯新闻/资讯推送（冲浪助手）"),
        (said(*ZH_CHAT), NEEDS_REVIEW, "私人飞信/闲聊非目标域"),
        (said(*ZH_BROKER_NEWS) & said(*ZH_MARKET), NEEDS_REVIEW, "券商投研/行情推送非四类目标域"),
        (said("投资建议仅供参考") & said(*ZH_DAILY), NEEDS_REVIEW, "券商投研推送非四类目标域"),
        (t.isin(*ZH_FRAGMENTS) | t.rlike(ZH_PHONE_ONLY), NEEDS_REVIEW, "信息碎片无法判断"),
        ((F.length(t) <= 6) & ~said(*ZH_SHORT), NEEDS_REVIEW, "过短无法判断"),
    ]
    return change(cases, F.lit("AD"))


def reviewed_changes(rows: DataFrame, order: str = "seq") -> DataFrame:
    """(id, old, new, reason, severity) of the rows (id, text, label, ``order``) labelled AD that should not be, one for each id.

    Of the changes of an id the first in ``order`` holds. A list for people goes by severity, then id.
    """
    found = changed_rows(rows.filter("trim(label) = 'AD'"), review_ad_zh(F.col("text")), "id", order)
    first = found.groupBy("id").agg(F.min_by(F.struct("label", "reason"), order).alias("d"))
    return first.select("id", F.lit("AD").alias("old"), F.col("d.label").alias("new"), "d.reason", (F.array_position(F.array(*(F.lit(x) for x in SEVERITY)), F.col("d.label")) - 1).alias("severity"))
