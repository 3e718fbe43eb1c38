"""Queries over label repair, word cascades and contradiction flags of packs in four languages.

The SQL is written out by itself, words and all, so that it checks those of the operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import audits, keyword_cascade, labels, pack_flags, regional
from textloom.operators.cascade import changed_rows
from textloom.plans.views import VIEWS, query, view

PHRASES = {
    "id": (
        "Selamat anda pemenang undian", "PIN: 8899 klaim di blogspot", "hadiah mobil toyota", "kirim uang ke rekening BRI 0123", "isi dl pulsa ke 081234567890", "poin telkomsel dan kupon", "jual blackberry murah 085211112222", "iphone disc pin bb 2A",
        "pinjaman dana tunai hub 081399998888", "tanpa agunan bunga ringan", "togel sgp edisi hari ini", "dukun pelet ampuh", "video bokep", "paket flash kuota 2GB *123*", "promo diskon spesial", "paket berhasil diaktifkan", "isi ulang sukses kode transaksi 9981",
        "sisa kuota flash anda 1GB", "kode OTP 123456", "kode verifikasi 4455 jangan berikan", "telkomsel beri hadiah klik bit.ly", "tagihan anda", "mytelkomsel aktifkan rbt", "hadiah ke-2 cek pin", "ayo beli paket", "resi pengiriman 77123", "halo apa kabar", "transfer ke rek BCA",
        "XL axiata kupon", "bonus pulsa untuk isi ulang", "anda telah memenangkan 10 juta", "grandprize mobil",
    ),
    "hi": (
        "Who won the match? reply within 24 hrs", "your number has won 500,000 GBP", "Congratulations! claim your cash prize", "full talktime recharge alert", "dial karein *121# best offer janiye", "Indian Railways PNR 4455667788", "service has been activated", "OTP 445566 for txn id 99",
        "sexy call girl xxx", "get laid tonight", "sms sending job earn rs. 5000 call now", "receive money through mobile banking", "provide mobile no and mmid", "open an account with federal bank", "win a hong kong trip with hyundai", "had won mobile phone dial 55",
        "winning an ipod", "ecovillage free car", "see http://m.google.co.in", "trip to thailand 3lac wfp", "send ur email id", "flat 50% off sale!", "loan offer apply now", "a/c credited 5000 debited 200", "lottery jackpot", "won a watch", "which team? option 1) A 2) B", "hello friend",
        "work from home earn daily", "thanks for being a member", "2 bhk flat in noida", "send your resume", "blyk all your replies free", "pack expires validity", "hiring walk in interview", "caller tune service",
    ),
    "zh": (
        "双色球专家推荐", "双色球自选回复", "双色球已中奖5元", "请转账到安全 账户", "涉嫌洗钱 公安通知", "恭喜您中奖 点击领奖", "兑奖请看 http://a.cn/x1", "您账户1234于5月消费", "您的验证码是１２３４５６", "取件码 8-1 丰巢", "代 开发票", "技师上门", "澳门赌场", "明日必涨 内线",
        "私募基金 建仓", "诚寻好项目 合作资金", "代办各院校大专", "无抵押 当天放款 13812345678", "招商银行 信用卡 小额贷款", "楼盘首付 贷款", "冲浪助手 新闻", "飞信好友", "财富早间版 仅供参考", "投资建议仅供参考 收盘", "大众点评 抵用券", "中国移动 充值优惠 权益", "余额不足 话费",
        "还款成功 到账 500元", "信用卡 账单 还款100.5元", "起诉 律师函", "立即还款", "防汛 气象预警", "顺丰 包裹", "保单 续保", "车牌 车辆", "施工 派单", "明晚到后天 多云", "满意度 抽奖", "服务评价", "额度已放 预授信", "白癜风 筛查", "课程 培训", "新品 预售 红包 限时", "退订回T 验证码发给",
        "恭喜您今天中奖", "免费 会员 福利", "约炮 成人", "早", "VIP6 贵宾客户-专享活动特权", "套餐升级 成人视频", "http 福利 优惠", "提现 尾号88 支出 20元",
    ),
    "en": (
        "you have won a cash prize", "WINNER!! claim code 88", "account statement shows 800 un-redeemed points to claim call", "verification code 445566", "your otp is 1234", "tracking number 99", "free ringtone subscription", "reply STOP discount", "20% off", "sexy xxx dogging", "secret admirer",
        "lol see you later at dinner", "yeah coming to the movie", "has been credited", "guaranteed £900 prize", "nokia tone poly# tones for you", "get laid", "plain words here", "to claim txt", "jackpot", "booking confirmed", "caller tune subscription", "horny naked", "unsubscribe offer", "ringtone order",
        "won £500 now",
    ),
}


def _pick(words: tuple[str, ...], at: str) -> str:
    return "split_part('" + "~".join(words).replace("'", "''") + f"', '~', CAST(1 + ({at}) % {len(words)} AS INT))"


def _text(words: tuple[str, ...]) -> str:
    n = len(words)
    return f"{_pick(words, 'k')} || CASE WHEN q % 3 = 0 THEN '' ELSE ' ' || {_pick(words, f'(k * 7 + CAST(floor(k / {n}) AS BIGINT) * 5 + 3)')} END"


#: Texts in four languages made of phrases that the word lists know, with a label and an original label that go round.
VIEWS["regional"] = (("orders",), "SELECT msg_id, CAST(msg_id AS STRING) AS id, language, CASE WHEN msg_id % 97 = 0 THEN ' ' WHEN language = 'id' THEN " + _text(PHRASES["id"]) + " WHEN language = 'hi' THEN " + _text(PHRASES["hi"]) + " WHEN language = 'zh' THEN " + _text(PHRASES["zh"]) + " ELSE " + _text(PHRASES["en"])
    + """ END AS text,
  CASE (k * 3 + q) % 6 WHEN 0 THEN 'TRANSACTION' WHEN 1 THEN 'AD' WHEN 2 THEN 'HARASS' WHEN 3 THEN 'FRAUD' WHEN 4 THEN 'NEEDS_REVIEW' ELSE CASE WHEN msg_id % 51 = 0 THEN '' ELSE 'AD' END END AS label,
  CASE WHEN language = 'id' THEN CASE WHEN k % 2 = 0 THEN '1' ELSE '0' END WHEN k % 2 = 0 THEN 'spam' ELSE 'ham' END AS original
FROM (SELECT o_orderkey AS msg_id, CAST(floor(o_orderkey / 4) AS BIGINT) AS k, CAST(floor(o_orderkey / 400) AS BIGINT) AS q,
  CASE o_orderkey % 4 WHEN 0 THEN 'zh' WHEN 1 THEN 'en' WHEN 2 THEN 'hi' ELSE 'id' END AS language FROM orders) AS o""")


def rows(spark, d, language=None):
    out = view(spark, d, "regional")
    return out if language is None else out.filter(F.col("language") == language)


def case_of(cases: list[tuple[str, str, str]], rows_sql: str) -> str:
    """First case that holds; a null label where it is the row's own."""
    said = " ".join(f"WHEN {p} THEN ['{x}', '{r}']" for p, x, r in cases)
    return f"SELECT id, CASE WHEN d[1] <> label AND d[1] <> '' THEN d[1] END AS label, CASE WHEN d[1] <> label AND d[1] <> '' THEN d[2] ELSE '' END AS reason FROM (SELECT id, label, CASE {said} ELSE ['', ''] END AS d FROM ({rows_sql}))"


def has(words: str, column: str = "low") -> str:
    return f"regexp_matches({column}, '{words}')"


ID_ROWS = f"""
SELECT *, (phones AND personal AND cheap) AS shop FROM (SELECT *, {has('pinjaman|pinjmn|dana tunai|kta|tanpa agunan|bpkb|bunga')} AND personal AS loan, {has('paket flash|kuota|bronet|iring|rbt|mytelkomsel|aktifkan|[*]123[*]|[*]808[*]|grabcar|grabtaxi|diskon')} AND NOT prize AND NOT (phones AND personal) AS promo
FROM (SELECT id, label, low, {has('pemenang|pin pemenang|pin:|kode pin|grandprize|gebyar|toyota|all new yaris|blogspot|undian bri|cek di: bit[.]ly')} OR (contains(low, 'hadiah') AND {has('mobil|rp[.]175|rp175|milyar|klaim|info hadiah')}) AS prize,
  {has('(rek|rekening|transfer).{0,40}(bri|bca|mandiri|bni)')} AND {has('kirim|transfer|uang')} AS bank, {has('isi[[:space:]]*(dl[[:space:]]*)?pulsa|krim plsa|kirim pulsa')} AND {has('08|rek|rekening')} AS credit,
  {has('indosat|telkomsel|xl axiata|tri ')} AND {has('poin|kupon')} AND NOT {has('blogspot|pin:|toyota|yaris|pin pemenang')} AS true_draw,
  {has('blackberry|bb dakota|bb onyx|bb torch|bb gemini|bb z10|iphone|samsung|laptop')} AS phones, {has('08[0-9]{8,}|pin bb')} AS personal, {has('disc|diskon|discon|promo|big sale|jt|rb|murah')} AS cheap,
  {has('telkomsel|indosat|mytelkomsel|axis|xl |[[]xl[]]')} AS telco, {has('togel|angka jitu|sgp edisi')} AS togel, {has('dukun|santet|pelet|pesugihan')} AS dukun, {has('seks|bokep|dewasa|vcs')} AS adult,
  {has('berhasil diaktifkan|berhasil[.]|isi ulang|topup|sisa kuota|sudah di non-aktifkan|telah aktif|kode transaksi|orderan sedang kami proses')} AS result,
  {has('promo|spesial untuk|yuks|ayo')} AS call, {has('berhasil diaktifkan|isi ulang|topup|sisa kuota flash anda|sudah di non-aktifkan|kode transaksi')} AS done
FROM (SELECT id, label, lower(text) AS low FROM regional WHERE language = 'id')))"""
ID_CASES = [
    ("label = 'NEEDS_REVIEW' AND (prize OR shop)", "FRAUD", "REVIEW漏标诈骗"), ("label = 'NEEDS_REVIEW' AND (loan OR togel OR dukun)", "HARASS", "REVIEW漏标骚扰"), ("label = 'AD' AND result AND NOT call AND done", "TRANSACTION", "业务结果通知误标广告"),
    ("label = 'TRANSACTION' AND loan AND NOT result", "HARASS", "事务误标的贷款推销"), ("label = 'TRANSACTION' AND prize", "FRAUD", "事务误标的假中奖"), ("label = 'TRANSACTION' AND phones AND personal", "FRAUD", "事务误标的灰产手机店"),
    ("label = 'FRAUD' AND promo AND NOT bank", "AD", "运营商/正规促销误标诈骗"), ("label <> 'HARASS' AND (loan OR togel OR dukun OR adult) AND NOT prize", "HARASS", "灰产贷款/赌博/成人/巫术骚扰"),
    ("label <> 'FRAUD' AND shop AND NOT telco", "FRAUD", "私人号超低价电子产品灰产/疑似诈骗店"), ("label <> 'FRAUD' AND (prize OR bank OR credit) AND NOT true_draw", "FRAUD", "假中奖/要转账/要充值诈骗"),
]
ID_FIXES = case_of(ID_CASES, ID_ROWS)


@query("repair_id", f"""
WITH r AS ({ID_FIXES}), c AS (SELECT id, label AS new, reason, 100 AS priority FROM r WHERE label IS NOT NULL UNION ALL SELECT id, 'HARASS', 'agent', 80 FROM regional WHERE language = 'id' AND msg_id % 5 = 0),
m AS (SELECT id, arg_max(new, priority) AS new, arg_max(reason, priority) AS reason FROM c GROUP BY id)
SELECT p.id, coalesce(m.new, p.label) AS label, CASE WHEN m.new <> p.label THEN '[fix:' || p.label || '->' || m.new || '] ' || m.reason ELSE '' END AS notes FROM regional p LEFT JOIN m ON p.id = m.id WHERE p.language = 'id'""", "regional")
def repair_id(spark, d):
    """Rules (priority 100) go over an agent's corrections (80)."""
    packs = rows(spark, d, "id")
    none = F.lit("").alias("notes"), F.lit("a").alias("annotator")
    found = changed_rows(packs, regional.repair_id(F.col("text"), F.col("label")), "id", F.col("label").alias("old"))
    rules = found.select("id", "old", F.col("label").alias("new"), "reason", F.lit("rules").alias("source"), F.lit(100).alias("priority"), F.lit(0).alias("seq"))
    agent = packs.filter("msg_id % 5 = 0").select("id", F.col("label").alias("old"), F.lit("HARASS").alias("new"), F.lit("agent").alias("reason"), F.lit("agent").alias("source"), F.lit(80).alias("priority"), F.lit(0).alias("seq"))
    return labels.apply_corrections(packs.select("id", "label", *none), labels.merge_corrections(rules.unionByName(agent))).select("id", "label", "notes")


HI_ROWS = f"""SELECT *, {has('ongratulations')} AND {has('won|claim|voucher|pearl set|lucky winner')} AND {has('claim|absolutely free|pearl|cash|gbp|pounds')}
  OR {has('(your number (has )?won|has been awarded|is selected for|winner![[:space:]]*[0-9]|claim your prize|cash prize|[0-9]{3,},[0-9]{3}[[:space:]]*(gbp|pounds|[$])|lottery held|intl draw|coca-?cola.*/?uk|hot diamond|yahoo/?msn lottery)')} AS prize,
  {has('(who (won|do you|is)|which (team|player)|how many|can you guess|want to know|want a sample|[\\^]1/|[\\^]yes|reply within|option [123]|1[)] |2[)] |3[)])')} AS quiz, {has('get laid|sexy|call girl|xxx|dating service|adult')} AS adult,
  {has('(sms sending job|earn rs[.]?[[:space:]]*[0-9]+|work from home).{0,40}(call|www)')} AS job,
  (contains(low, 'indian railways') AND contains(low, 'pnr')) OR {has('service has been activated|settings have been successfully delivered|mms settings have been successfully|mobile office is active|mobile office & mms is active|please complete registration process|request timed out|indian railways servers are very busy')} OR {has('\\botp\\b|verification code|a/c credited|debited|txn id')} AS result,
  {has('(full talktime|ke recharge|recharge (par|pe|mein|now|with)|talktime (validity|ki validity)|best (full )?talktime|recharge alert|stvs? to con|dial karein [*]121|best offer janiye|airtel 3g.*(watch|play|games|tv channels)|get train details|send and receive money instantly|hello tune|football-barclays|go to http://m[.]google)')} AS recharge
FROM (SELECT id, label, text, lower(text) AS low FROM regional WHERE language = 'hi')"""
HI_CASES = [
    ("prize", "FRAUD", "假中奖/彩票认领诈骗"), ("quiz AND adult", "HARASS", "问答/竞猜增值短信，非诈骗"), ("quiz", "AD", "问答/竞猜增值短信，非诈骗"), ("adult OR job", "HARASS", "成人/灰产兼职骚扰"), ("result", "TRANSACTION", "业务结果/系统激活/PNR等事务通知"),
    ("contains(low, 'receive money through mobile banking') OR contains(low, 'provide mobile no') AND contains(low, 'mmid')", "TRANSACTION", "网银/手机银行收款说明"), ("recharge AND label IN ('TRANSACTION', 'FRAUD', 'HARASS', 'NEEDS_REVIEW')", "AD", "充值套餐/增值服务促销"), ("recharge", "", ""),
    ("contains(low, 'open an account with federal bank')", "AD", "银行开户促销"), ("contains(low, 'win a hong kong trip') AND contains(low, 'hyundai')", "AD", "车商活动抽奖促销"),
    ("(contains(low, 'had won mobile phone') OR contains(low, 'winning an ipod')) AND contains(low, 'dial') AND label = 'FRAUD'", "AD", "增值抽奖拨号促销(非经典转账诈骗)"), ("contains(low, 'had won mobile phone') OR contains(low, 'winning an ipod')", "", ""),
    ("contains(low, 'ecovillage') AND label = 'FRAUD'", "AD", "房产促销话术"), ("contains(low, 'http://m.google.co.in') AND length(text) < 80", "NEEDS_REVIEW", "残缺链接无法判断"),
    (f"{has('ticket to thailand|trip to thailand|pack ur bag')} AND {has('600000|3lac|wfp|qualfiars')}", "FRAUD", "高门槛旅游抽奖/传销式诱导"), ("contains(low, 'send ur email id')", "FRAUD", "索要邮箱/联系方式可疑"),
]


@query("repair_hi", f"WITH a AS ({case_of(HI_CASES, HI_ROWS)}), b AS (SELECT h.id, coalesce(a.label, h.label) AS label, a.reason, h.quiz AND NOT h.adult AND NOT h.job AND coalesce(a.label, h.label) = 'HARASS' AS again FROM ({HI_ROWS}) h JOIN a ON h.id = a.id) SELECT id, CASE WHEN again THEN 'AD' ELSE label END AS label, reason, CASE WHEN again THEN '体育/娱乐问答增值促销' ELSE '' END AS second_reason FROM b", "regional")
def repair_hi(spark, d):
    first = rows(spark, d, "hi").withColumn("d", regional.repair_hi(F.col("text"), F.col("label"))).withColumn("label", F.coalesce("d.label", "label"))
    again = first.withColumn("e", regional.repair_hi_second(F.col("text"), F.col("label")))
    return again.select("id", F.coalesce("e.label", "label").alias("label"), "d.reason", F.col("e.reason").alias("second_reason"))


@query("repair_zh_unify", """
WITH u AS (SELECT id, label, CASE WHEN contains(text, '双色球') AND (contains(text, '专家推荐') OR contains(text, '自选回')) THEN ['HARASS', '双色球荐号/投注博彩招揽统一HARASS'] WHEN contains(text, '双色球') AND contains(text, '已中奖') AND NOT contains(text, '专家推荐') THEN ['TRANSACTION', '已购彩票中奖结果通知'] END AS d, msg_id FROM regional WHERE language = 'zh'),
c AS (SELECT id, d[1] AS new, d[2] AS reason, 120 AS priority FROM u WHERE d IS NOT NULL AND d[1] <> label UNION ALL SELECT id, 'FRAUD', 'rules', 100 FROM u WHERE msg_id % 3 = 0),
m AS (SELECT id, arg_max(new, priority) AS new, arg_max(reason, priority) AS reason FROM c GROUP BY id)
SELECT u.id, coalesce(m.new, u.label) AS label, CASE WHEN m.new <> u.label THEN '[fix:' || u.label || '->' || m.new || '] ' || m.reason ELSE '' END AS notes FROM u LEFT JOIN m ON u.id = m.id""", "regional")
def repair_zh_unify(spark, d):
    """The unification (priority 120) goes over rules (100)."""
    packs = rows(spark, d, "zh")
    found = changed_rows(packs, regional.unify_zh(F.col("text"), F.col("label")), "id", F.col("label").alias("old"))
    unified = found.select("id", "old", F.col("label").alias("new"), "reason", F.lit("post_unify").alias("source"), F.lit(120).alias("priority"), F.lit(0).alias("seq"))
    rules = packs.filter("msg_id % 3 = 0").select("id", F.col("label").alias("old"), F.lit("FRAUD").alias("new"), F.lit("rules").alias("reason"), F.lit("rules").alias("source"), F.lit(100).alias("priority"), F.lit(0).alias("seq"))
    merged = labels.merge_corrections(unified.unionByName(rules))
    return labels.apply_corrections(packs.select("id", "label", F.lit("").alias("notes"), F.lit("a").alias("annotator")), merged).select("id", "label", "notes")


BANKS = "邮储银行|平安银行|兴业银行|招商银行|中国银行|工商银行|建设银行|农业银行|交通银行|中信银行|光大银行|民生银行|浦发银行|华夏银行|广发银行"
CARRIERS = "中国移动|中国联通|中国电信|杭州移动|【移动】|【联通】|【电信】"
BRANDS = "【天猫】|【京东】|【大众点评】|【小米】|【红牛|世纪佳缘|无线城市"
OFFICIAL = f"({has(BANKS, 't')} AND ({has('新一贷|随兴贷|邮储银行|信用卡|办卡', 't')} OR ({has('房产抵押|消费贷款|授信', 't')} AND NOT {has('当天放款|当天下款|无抵押|免担保|下款快', 't')})))"
ZH_CASES = [
    ("t = ''", "NEEDS_REVIEW", "空文本无法判断"), (f"{has('安全账户|账户异常|洗钱|提供密码|告知验证码|把验证码|转账到安全', 'n')} AND NOT contains(t, '法院对面')", "FRAUD", "钓鱼/冒充或索要验证码密码"), (f"contains(t, '涉嫌') AND {has('公安|检察院|法院传|刑事', 't')}", "FRAUD", "假公检法恐吓话术"),
    (f"{has('恭喜您中奖|您已中奖|中奖通知|领取奖金|立即兑奖|点击领奖|免费领取iPhone|0元领iPhone|中大奖', 'n')} AND NOT {has(f'双色球|不保证中奖|大众点评|红牛|中福在线|{BRANDS}|{CARRIERS}|{BANKS}', 't')}", "FRAUD", "假中奖/诱导领奖"),
    (f"{has('领奖|兑奖', 'n')} AND {has('(?i)https?://|wap[.]|[0-9_[:alpha:]一-龥]+[.](cn|com)/[0-9_[:alpha:]一-龥]+', 't')} AND NOT {has(f'{BRANDS}|{CARRIERS}|{BANKS}|中福在线|红牛|无线城市|中国移动|139邮箱', 't')}", "FRAUD", "不明短链领奖诱导"),
    (has("您账户[0-9]+于.*(扣款|入账|消费|支出|存入)", "digits"), "TRANSACTION", "账户扣款/入账等业务结果告知（主意图）"), (f"{has('(验证码是|验证码为|动态码|校验码是|短信验证码)[：:[:space:]]*[0-9]{4,8}', 'digits')} AND NOT {has('转发验证码|告诉别人|提供给', 't')}", "TRANSACTION", "纯验证码事务短信"),
    (f"{has('取件码|快递已到达|已到达驿站|待取件|丰巢', 'n')} AND NOT {has('优惠|促销|办卡|充值送', 't')}", "TRANSACTION", "物流取件事务告知"), ("contains(n, '代开') AND contains(n, '发票')", "HARASS", "代开发票灰产招揽"),
    (has("莞式|包夜|特殊服务|出台服务|技师上门|裸聊|一夜情|全套上门", "n"), "HARASS", "成人/色情服务招揽"), (has("娱乐城|百家乐|六合彩|时时彩|真人荷官|开户即送|送彩金|扎金花|澳门赌场", "n"), "HARASS", "赌博/博彩招揽"),
    (f"contains(n, '双色球') AND contains(n, '专家推荐') AND {has('投注|自选回', 'n')}", "HARASS", "彩票投注招揽（专家荐号诱导投注）"),
    (f"{has('带学员|带客买入|带客建|锁仓金股|明日必涨|内线|冲高出货|尾盘买入', 'n')} OR (contains(n, '私募') AND {has('必涨|带学员|金股|拉停|建仓', 'n')})", "HARASS", "荐股带客灰产硬推销"), (f"{has('合作前期无费用|前期无费用|诚寻好项目', 'n')} AND {has('资金|合作', 'n')}", "HARASS", "资金中介/灰产合作招揽"),
    (f"{has('代办证|假证|办假证|真实驾驶证|代办各院校', 'n')} OR (contains(n, '代办') AND {has('发票|营业执照|资格证|驾驶证|大专|大本', 'n')})", "HARASS", "代办证件/学历灰产"),
    (f"{has('无抵押|免担保|当天放款|当天下款|3天放款|日放款|下款快|放款快|小额贷款|信用贷|抵押贷款|二次贷款|装修贷款|大额无抵|信用岱歀', 'n')} AND NOT {has('可正常贷款|可贷款|不限购|淘宝贷款|天猫贷款|购车|楼盘|别墅|公寓|商铺|售楼|永久产权|首付|看房|现房|房产投资|澳洲房产|新加坡', 't')} AND NOT {OFFICIAL} AND ({has('无抵押|免担保|当天放款|当天下款|小额贷款|下款快|放款快|3天放款|日放款|信用岱歀|链家金融', 'n')} OR ({has('(^|[^0-9])1[3-9][0-9]{9}($|[^0-9])', 'n')} AND {has('贷款|放款|下款|抵押|信用贷', 'n')}))", "HARASS", "无抵押/当天放款/私人中介硬推销贷款"),
    ("contains(t, '冲浪助手')", "NEEDS_REVIEW", "纯新闻/资讯推送（冲浪助手）"), (has("飞信好友|【发自飞信】|希望加您为飞信", "t"), "NEEDS_REVIEW", "私人飞信/闲聊非目标域"), (f"{has('财富早间版|财富收盘版|财富版：', 't')} AND {has('投资建议|仅供参考|仓位|指数|股指|减仓|逢高', 't')}", "NEEDS_REVIEW", "券商投研/行情推送非四类目标域"),
    (f"contains(t, '投资建议仅供参考') AND {has('财富|收盘|早间', 't')}", "NEEDS_REVIEW", "券商投研推送非四类目标域"), ("t IN ('2.最新活动', 'VIP6 贵宾客户-专享活动特权')", "NEEDS_REVIEW", "信息碎片无法判断"), (f"length(t) <= 6 AND NOT {has('优惠|验证码|中奖', 't')}", "NEEDS_REVIEW", "过短无法判断"),
]
ZH_ROWS = "SELECT id, label, t, digits, regexp_replace(digits, '[[:space:]/]+', '', 'g') AS n FROM (SELECT id, label, trim(text) AS t, translate(trim(text), '０１２３４５６７８９　', '0123456789 ') AS digits FROM regional WHERE language = 'zh' AND label = 'AD')"


@query("review_ad_zh", f"SELECT id, 'AD' AS old, label AS new, reason, CASE label WHEN 'FRAUD' THEN 0 WHEN 'TRANSACTION' THEN 1 WHEN 'HARASS' THEN 2 ELSE 3 END AS severity FROM ({case_of(ZH_CASES, ZH_ROWS)}) WHERE label IS NOT NULL", "regional")
def review_ad_zh(spark, d):
    return regional.reviewed_changes(rows(spark, d, "zh"), "msg_id").select("id", "old", "new", "reason", F.col("severity").cast("int").alias("severity"))


def flag_sql(flags: dict[str, str], rows_sql: str, samples: int) -> str:
    cases = ", ".join(f"CASE WHEN {p} THEN '{n}' END" for n, p in flags.items())
    return f"SELECT flag, count(*) AS n, array_to_string(list(msg_id ORDER BY msg_id)[1:{samples}], ',') AS samples FROM (SELECT msg_id, unnest([{cases}]) AS flag FROM ({rows_sql})) WHERE flag IS NOT NULL GROUP BY flag"


EN_ROWS = f"""SELECT msg_id, label, original, {has('you have won|you.ve won|winner!!|prize reward|claim code|to claim call|to claim txt|jackpot|guaranteed £|guaranteed [$]|bonus prize|unredeemed bonus|account statement.{0,80}claim|won a guaranteed|awarded .{0,30}prize|cash prize|£900 prize|£1000 prize|£2000')} AS f,
  {has('transaction id|account has been refilled|prepaid account balance|verification code|one-time password|[^a-z0-9]otp[^a-z0-9]|^otp[^a-z0-9]|[^a-z0-9]otp$|out for delivery|tracking number|booking confirmed|has been credited|has been debited')} AS t,
  {has('ringtone|subscription|% off|discount|reply stop|txt stop|free msg|freemsg|will be charged|std txt rate')} AS a, {has('xxx|sexy|horny|get laid|dogging|hardcore|secret admirer|meet someone sexy|naked')} AS h,
  {has('(^|[^a-z0-9_])(lol|haha|yeah|okie|meet|later|love you|miss you|dinner|movie|coming)($|[^a-z0-9_])')} AS p FROM (SELECT msg_id, label, original, lower(text) AS low FROM regional WHERE language = 'en')"""
EN_FLAGS = {
    "fraud_kw_not_FRAUD": "f AND label <> 'FRAUD'", "FRAUD_but_adultish": "label = 'FRAUD' AND h AND NOT f", "FRAUD_but_adish": "label = 'FRAUD' AND a AND NOT f", "TXN_but_fraud_kw": "label = 'TRANSACTION' AND f",
    "TXN_on_spam_no_txn_kw": "label = 'TRANSACTION' AND original = 'spam' AND NOT t", "ham_personal_forced_class": "label IN ('TRANSACTION', 'AD', 'HARASS', 'FRAUD') AND original = 'ham' AND p AND NOT f AND NOT t AND NOT a AND NOT h",
    "adult_kw_not_HARASS": "h AND label NOT IN ('HARASS', 'FRAUD', 'NEEDS_REVIEW')", "REVIEW_but_fraud_kw": "label = 'NEEDS_REVIEW' AND f", "REVIEW_but_txn_kw": "label = 'NEEDS_REVIEW' AND t AND NOT f", "AD_but_fraud_kw": "label = 'AD' AND f", "HARASS_but_fraud_kw": "label = 'HARASS' AND f",
}


@query("qa_flags_en", flag_sql(EN_FLAGS, EN_ROWS, 10), "regional")
def qa_flags_en(spark, d):
    return audits.flag_samples(audits.flags(rows(spark, d, "en"), pack_flags.flags_en(F.col("text"), F.col("label"), F.col("original"))), "msg_id", 10)


ID_FLAG_ROWS = f"SELECT msg_id, label, text, low, original, contains(low, 'hadiah') AS gift, {has('otp|kode verifikasi|kode otp|kode rahasia|berhasil ditransfer|pembayaran berhasil|saldo anda|tagihan|resi|kode pengambilan')} AS t, {has('promo|diskon|spesial|kuota|paket flash|berlangganan|aktifkan|mytelkomsel|voucher|cashback|beli paket|iring|rbt')} AS a FROM (SELECT *, lower(text) AS low FROM regional WHERE language = 'id')"
ID_FLAGS = {
    "疑似假中奖未标FRAUD": f"label IN ('TRANSACTION', 'AD', 'HARASS') AND ({has('pemenang|hadiah ke-|grandprize|cek pin')} OR (gift AND {has('klik|pin|bit[.]ly|blogspot|info hadiah')})) AND NOT contains(low, 'telkomsel') AND (label <> 'AD' OR {has('blogspot|bit[.]ly|pin pemenang|toyota|rp[.]175')})",
    "TXN却像诈骗中奖": f"label = 'TRANSACTION' AND {has('hadiah|pemenang|pin pemenang|blogspot')}", "TXN却像贷款骚扰": f"label = 'TRANSACTION' AND {has('pinjaman|tanpa agunan|bunga')} AND NOT contains(low, 'otp')",
    "TXN却像广告促销": f"label = 'TRANSACTION' AND a AND NOT t AND {has('aktifkan|promo|diskon|beli paket')}", "AD却像假中奖诈骗": f"label = 'AD' AND ({has('pemenang|pin:|blogspot|grandprize')} OR (gift AND {has('toyota|rp[.]|mobil')}))",
    "AD却像灰产贷款": f"label = 'AD' AND {has('pinjaman|tanpa agunan|bunga %|bunga%')} AND {has('08[0-9]{8,}', 'text')}", "HARASS却像OTP事务": f"label = 'HARASS' AND t AND {has('[0-9]{4,8}', 'text')} AND NOT contains(low, 'pinjaman')",
    "HARASS却像假中奖": f"label = 'HARASS' AND {has('pemenang|hadiah')} AND {has('pin|klik|blogspot')}", "FRAUD却像运营商广告": f"label = 'FRAUD' AND {has('mytelkomsel|paket flash|kuota')} AND NOT {has('pemenang|pin:|blogspot|toyota|klaim')}",
    "FRAUD却像普通OTP": f"label = 'FRAUD' AND {has('otp|kode verifikasi')} AND NOT {has('jangan berikan|kirimkan otp|minta otp')} AND {has('(kode|otp).{0,10}[0-9]{4,8}')} AND NOT gift", "REVIEW却像清晰OTP": f"label = 'NEEDS_REVIEW' AND {has('otp|kode verifikasi')} AND {has('[0-9]{4,8}', 'text')} AND NOT {has('hadiah|pemenang')}",
    "REVIEW却像假中奖": f"label = 'NEEDS_REVIEW' AND {has('pemenang|pin pemenang|grandprize')}", "原标诈骗却标成事务": "original = '1' AND label = 'TRANSACTION'",
}


@query("qa_flags_id", flag_sql(ID_FLAGS, ID_FLAG_ROWS, 15), "regional")
def qa_flags_id(spark, d):
    return audits.flag_samples(audits.flags(rows(spark, d, "id"), pack_flags.flags_id(F.col("text"), F.col("label"), F.col("original"))), "msg_id", 15)


HI_FLAG_ROWS = f"SELECT msg_id, label, text, low, original, {has('you have won|you.ve won|claim prize|lottery|jackpot|congratulations you|selected as winner|verify account immediately|account suspended|click here to claim|won a|winner!|cash prize|claim your')} AS f, {has('otp|one time password|verification code|a/c credited|account credited|debited|txn id|transaction id|delivered|out for delivery|order confirmed|recharge successful')} AS t, {has('[0-9]{4}', 'text')} AS digits FROM (SELECT *, lower(text) AS low FROM regional WHERE language = 'hi')"
HI_FLAGS = {
    "疑似诈骗未标FRAUD": f"label IN ('TRANSACTION', 'AD', 'HARASS') AND (f OR {has('(won|winner|claim).{0,20}(prize|cash|£|[$]|rs[.]?[[:space:]]*[0-9])')})", "TXN却像诈骗": "label = 'TRANSACTION' AND (f OR (contains(low, 'claim') AND contains(low, 'prize')))",
    "TXN却像广告": f"label = 'TRANSACTION' AND {has('loan offer|apply now|flat |% off|sale!')} AND NOT t", "TXN短句无事务信号": f"label = 'TRANSACTION' AND length(text) < 60 AND NOT t AND NOT digits AND NOT {has('otp|credited|debited|delivered|recharge')}",
    "AD却像诈骗": f"label = 'AD' AND (f OR (contains(low, 'won') AND {has('prize|cash|claim')}))", "AD却像骚扰": f"label = 'AD' AND {has('get laid|sexy|call girl|xxx')}", "HARASS却像OTP": "label = 'HARASS' AND t AND digits", "HARASS却像诈骗": "label = 'HARASS' AND f",
    "FRAUD却像问答促销": f"label = 'FRAUD' AND {has('who do you|which|reply within|option')} AND NOT f AND NOT {has('claim|won |winner')}", "FRAUD却像普通OTP": f"label = 'FRAUD' AND t AND NOT {has('claim|won')} AND {has('(otp|verification code).{0,10}[0-9]{4,}')}",
    "REVIEW却像清晰OTP/事务": "label = 'NEEDS_REVIEW' AND t AND digits AND NOT f", "REVIEW却像诈骗": "label = 'NEEDS_REVIEW' AND f", "原spam却标事务": "original = 'spam' AND label = 'TRANSACTION' AND NOT t",
}


@query("qa_flags_hi", flag_sql(HI_FLAGS, HI_FLAG_ROWS, 12), "regional")
def qa_flags_hi(spark, d):
    return audits.flag_samples(audits.flags(rows(spark, d, "hi"), pack_flags.flags_hi(F.col("text"), F.col("label"), F.col("original"))), "msg_id", 12)


def multi_rows(source: str) -> str:
    return f"""SELECT *, label IN ('TRANSACTION', 'AD', 'HARASS', 'FRAUD', 'NEEDS_REVIEW') AS valid, lower(text) AS low,
  {has('(?is)(claim (your |ur )?(prize|award)|to claim (call|txt)|your number (has )?won|has been awarded|lottery held|prize guaranteed|account statement.{0,60}(claim|bonus|un-?redeemed)|恭喜.{0,10}中奖|领奖|klaim hadiah|anda telah memenangkan|pin pemenang|£[0-9]{3,}.{0,20}(prize|award|claim)|won £|won [?])', 'text')} AS prize,
  {has('(?i)(otp|verification code|验证码|kode (otp|verifikasi)|one[- ]time (password|code))', 'text')} AS otp, {has('(?i)(unsubscribe|reply stop|退订|promo|diskon|discount|offer|recharge pack|full talktime|ringtone|套餐升级|限时优惠|buruan)', 'text')} AS promo,
  {has('(?i)(^|[^0-9a-z_一-龥])(sexy|sex|xxx|horny|get laid|porn|bokep|约炮|成人)($|[^0-9a-z_一-龥])', 'text')} AS adult, {has('(?i)(ringtone|nokia tone|poly#|tones? for|caller[[:space:]]*tune subscription)', 'text')} AS tones FROM ({source})"""


MULTI = {
    "invalid_or_empty": "NOT valid", "empty_text": "valid AND trim(text) = ''", "AD_looks_prize_fraud": f"label = 'AD' AND prize AND NOT {has('抵用券|优惠代码|大众点评', 'text')}", "nonTXN_looks_otp": "label IN ('AD', 'HARASS') AND otp AND NOT promo",
    "TXN_looks_hard_promo": f"label = 'TRANSACTION' AND {has('unsubscribe|reply stop|ringtone order|bonus pulsa.{0,20}isi ulang|cuma dgn isi ulang')}", "TXN_looks_fraud": f"label = 'TRANSACTION' AND ((language = 'zh' AND {has('恭喜中奖|点链接领|验证码发给', 'text')}) OR (language = 'en' AND prize))",
    "FRAUD_looks_ringtone_ad": "label = 'FRAUD' AND tones AND NOT prize", "AD_looks_adult_harass": "label = 'AD' AND adult AND NOT promo", "ham_forced_fourclass": "label IN ('AD', 'FRAUD', 'HARASS') AND original IN ('ham', '0', 'legit') AND NOT prize AND NOT tones AND NOT adult AND length(text) < 200",
    "spam_review_should_label": "label = 'NEEDS_REVIEW' AND original IN ('spam', '1') AND (prize OR tones OR adult OR promo)", "zh_missing_cjk": f"valid AND language = 'zh' AND length(text) > 30 AND NOT {has('[一-鿿]', 'text')}",
}
#: The Chinese pack has no binary label.
MULTI_SOURCE = "SELECT msg_id, language, text, label, CASE WHEN language <> 'zh' THEN original END AS original FROM regional"
MULTI_LIST = "list_filter([" + ", ".join(f"CASE WHEN {p} THEN '{n}' END" for n, p in MULTI.items()) + "], lambda x: x IS NOT NULL)"
CRITICAL_SQL = "['invalid_or_empty', 'empty_text', 'AD_looks_prize_fraud', 'nonTXN_looks_otp', 'TXN_looks_fraud', 'FRAUD_looks_ringtone_ad', 'ham_forced_fourclass']"


def multi_flagged(source: str) -> str:
    return f"SELECT msg_id, language, {MULTI_LIST} AS flags FROM ({multi_rows(source)})"


def multi(frame):
    binary = F.when(F.col("language") != "zh", F.col("original"))
    return audits.flags(frame, pack_flags.flags_multi(F.col("text"), F.col("label"), F.col("language"), binary))


@query("qa_flags", f"SELECT language AS pack, flag, count(*) AS n FROM (SELECT language, unnest(flags) AS flag FROM ({multi_flagged(MULTI_SOURCE)})) GROUP BY ALL", "regional")
def qa_flags(spark, d):
    return audits.flag_counts(multi(rows(spark, d)).withColumnRenamed("language", "pack"), "pack")


@query("qa_flags_multi", f"""
WITH f AS (SELECT language AS pack, len(list_filter(flags, lambda x: list_contains({CRITICAL_SQL}, x))) AS c, len(flags) AS all_flags FROM ({multi_flagged(MULTI_SOURCE)}))
SELECT pack, count(*) AS n, sum(c)::BIGINT AS critical, sum(all_flags - c)::BIGINT AS warnings, CASE WHEN sum(c) > 0 THEN 'FAIL' WHEN sum(all_flags) > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM f GROUP BY pack""", "regional")
def qa_flags_multi(spark, d):
    return audits.verdicts(multi(rows(spark, d)).withColumnRenamed("language", "pack"), "pack", pack_flags.CRITICAL)


@query("post_repair_audit", f"""
WITH r AS (SELECT p.msg_id, p.language, p.text, coalesce(a.label, p.label) AS label, p.original FROM regional p LEFT JOIN ({ID_FIXES}) a ON p.id = a.id WHERE p.language = 'id')
SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM ({multi_flagged('SELECT * FROM r')})) GROUP BY flag""", "regional")
def post_repair_audit(spark, d):
    fixed = rows(spark, d, "id").withColumn("label", F.coalesce(regional.repair_id(F.col("text"), F.col("label"))["label"], F.col("label")))
    return audits.flag_counts(multi(fixed))


HI_LABEL = f"""CASE WHEN {has('won|winner|claim award|lottery|congratulations won|number won|number selected|chevron|coca cola prize|hot diamond|british diamond|free car|contact claim|email claim|claim contact|claim email|ticket to thailand|extended till|qualifiars|6[.]50lac|wfp|what your number|get15grams|prize worth|cash prize|prize winner|lucky draw winner|lucky winner|you have been awarded|you have been selected|your number has been')} THEN 'FRAUD'
  WHEN {has('reply within 24|reply.*24 hrs|reply.*24 hours|blyk|aircel.*free|all your replies.*free|all your interactions.*free|all your.*free.*blyk')} THEN 'HARASS'
  WHEN {has('pnr|train detail|policy due|premium due|bill due|request timed out|code=|tid=|please complete registration|settings delivered|mobile office active|recharge alert|validity expired|data card expired|activate 3g|3g activate|settings successfully|thanks for being|thanks for your|you are enjoying|pack expires|you have been charged|service has been activated|info call 121|dial 121|balance information|[*]121#|[*]122[*]|[*]123[*]5#')} THEN 'TRANSACTION'
  WHEN {has('work from home|earn per day|earn daily|earn per month|earn from home|income per day|income per month|per month income|part time income|full time income|rs[.]? 15000|rs[.]? 30000|mobile/laptop repairing|hi-tech se|per month|per day|daily income|monthly income|cyber ?job|160by2|sent 4rm|sent from|sent by|send your resume|email your resume|homejobsindya|home jobs|work at home|earn extra income|business opportunity|no investment|free joining|free training|natural aloe vera|bee honey|network marketing|mlm|franchise opportunity')} THEN 'HARASS'
  WHEN {has('talktime|recharge|bhk|flat|plot|apartment|snapdeal|easemytrip|discount|% off|course|admission|training|hiring|walk|interview|loan|emi|insurance|health|treatment|doctor|holiday|trip|travel|food|restaurant|pizza|movie|music|game|data card|3g|internet|caller tune|ringtone|offer|deal|sale|free|gift|book|buy|shop|call now|sms now|limited|hurry|rush|new|latest|collection|fashion|property|realty|developer|service|repair|bank|credit card|contest|competition')} THEN 'AD'
  ELSE 'NEEDS_REVIEW' END"""


def reason_sql(cases: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {' AND '.join(has(p) for p in words.split(' & '))} THEN '{reason}'" for words, reason in cases) + f" ELSE '{other}' END"


HI_WHY = {
    "FRAUD": reason_sql([("won|winner", "假中奖诈骗，声称用户已中奖"), ("lottery|prize", "虚假抽奖/奖品诈骗"), ("selected & cash|award|prize", "虚假中奖，要求联系领取奖金"), ("chevron|coca cola|yahoo|msn", "虚假公司名义中奖诈骗"), ("free car", "虚假免费汽车/房产诱惑"), ("(ticket|trip) to thailand", "虚假旅游奖品诱导"), ("what your number", '虚假"你的号码"竞赛诈骗'), ("15grams", "虚假银币奖励诱导")], "虚假中奖/奖品诈骗"),
    "TRANSACTION": reason_sql([("pnr|train", "PNR/列车信息查询服务"), ("policy|premium", "保险保费到期通知"), ("bill", "账单到期通知"), ("request timed out|code=", "服务请求超时/系统通知"), ("settings|mobile office", "移动办公设置激活通知"), ("recharge alert|validity", "充值/有效期到期提醒"), ("thanks & member|support", "Blyk会员感谢消息"), ("activate|3g", "3G激活/服务通知"), ("balance|[*]121#|[*]123[*]", "账户余额/信息查询指引"), ("dial 121|info call", "客服信息查询指引"), ("you are enjoying|pack expires", "套餐到期提醒"), ("you have been charged", "扣费通知")], "业务通知/服务消息"),
    "HARASS": reason_sql([("reply within 24|blyk|aircel", "Blyk互动问答/骚扰式推销"), ("work from home|earn", "高薪诱惑/在家工作诈骗"), ("160by2|cyberjob", "代发短信/网络兼职骚扰"), ("sent 4rm|sent from", "代发短信骚扰"), ("business opportunity|franchise", "商业机会/加盟骚扰"), ("no investment|free joining", "零投资加盟诱惑"), ("natural aloe vera|bee honey", "微商/保健品推销骚扰"), ("income & month|day", "高薪收入诱惑"), ("per month|per day", "高薪诱惑"), ("rs[.]? 15000|rs[.]? 30000", "高薪课程/工作诱惑"), ("mobile/laptop|hi-tech", "高薪维修课程诱惑"), ("home jobs|work at home", "在家工作诱惑"), ("send your resume|email your resume", "简历收集骚扰")], "骚扰式推销/灰产"),
    "AD": reason_sql([("talktime|recharge", "充值/话费优惠促销"), ("bhk|flat|plot|apartment", "房产广告"), ("snapdeal|easemytrip", "电商/旅游促销"), ("discount|% off", "折扣促销广告"), ("course|admission|training", "教育/课程招生广告"), ("hiring|walk|interview", "招聘广告"), ("loan|emi|insurance", "贷款/保险广告"), ("health|treatment|doctor", "医疗/健康服务广告"), ("holiday|trip|travel", "旅游/度假套餐广告"), ("food|restaurant|pizza", "餐饮/食品促销"), ("movie|music|game", "娱乐/内容服务广告"), ("data card|3g|internet", "数据卡/网络服务广告"), ("caller tune|ringtone", "彩铃/音乐服务广告"), ("offer|deal|sale", "促销/优惠活动广告"), ("free|gift", "免费/赠品促销"), ("book|buy|shop", "购物/预订广告"), ("call now|sms now", "即时行动促销广告"), ("limited|hurry|rush", "限时促销广告"), ("new|latest", "新品/新款广告"), ("collection|fashion", "时尚/服装广告"), ("property|realty|developer", "房产/开发商广告"), ("service|repair", "维修服务广告"), ("bank|credit card", "银行/信用卡广告"), ("contest|competition", "竞赛/活动广告"), ("win & mobile|phone|laptop|bike|car|trip|cash|gold|silver|watch|voucher", "有奖活动促销"), ("sms & win|prize", "短信抽奖促销")], "商业促销广告"),
}


@query("cascade_keyword_hi", f"""
WITH a AS (SELECT id, low, CASE WHEN msg_id % 50 = 2 THEN 'AD' ELSE {HI_LABEL} END AS label FROM (SELECT id, msg_id, lower(text) AS low FROM regional WHERE language = 'hi'))
SELECT id, label, CASE label {' '.join(f"WHEN '{x}' THEN {why}" for x, why in HI_WHY.items())} ELSE '内容不确定，需人工审核' END AS reason FROM a""", "regional")
def cascade_keyword_hi(spark, d):
    packs = rows(spark, d, "hi").select("id", "msg_id", "text")
    given = packs.filter("msg_id % 50 = 2").select("id", F.lit("AD").alias("label"))
    return keyword_cascade.keyword_hi(packs, given).select("id", "label", "reason")


def count_of(words: str) -> str:
    return "(" + " + ".join(f"contains(t, '{w}')::INT" for w in words.split(" ")) + ")"


OPERATOR = "流量.*使用 语音.*使用 余额 话费 套餐 月租 充值 消费 积分.*领取 权益.*领取 日包 月包 流量包 语音包 叠加包 流量.*到账 语音.*到账 电子券.*到账 流量.*使用完 语音.*使用完 流量用尽 语音用尽 余额不足 扣费 代交 代扣 充值成功 交费 查询服务 服务评价 满意度 余额变动 话费余额 账户余额 自动充值 自动充 流量超套 业务办理 确认办理 中国移动 中国联通 中国电信"
BANK = "还款 扣款 到账 账单 提现 还款成功 还款失败 信用卡 银行 借呗 花呗 本期账单 未还 已还 尾号 卡号 消费提醒 支出提醒 收入提醒 退款 返现 返还 到账通知 信用卡还款 账单已结清 支付宝 微信支付 京东支付 自动还款 扣款成功 扣款失败"
ADS = "贷款 额度 借款 拒收请回复R 会员 权益 优惠 红包 福利 限时 免费领取 免费 特价 预授信 预批 特批 放宽 咨询电话 客服电话 http"
THREATS = "严重逾期 恶意透支 强制执行 起诉 法庭 律师函 上报征信 列入失信 冻结账户 划扣工资 联系单位 户籍地 催收 催缴 逾期记录 报送人行 征信系统 不良信用 默认拒偿 永不减免 申请司法 诉讼 开庭 最后期限 否则将 后果自负 拒不还款"
GOVERNMENT = "中国残联|助残日|共青团|12355|公益热线|防汛|抗旱|气象预警|教育部|严禁提前开学|存款保险|全国科技工作者日|科协|铁路安全|电力公司|国网|气象服务|手机气象|公益短信|廉洁|纪检|纪委监委"
AMOUNTS = "(还款|到账|余额|账单|消费|充值).*[0-9]+[.]?[0-9]*元|尾号[0-9_[:alpha:]一-龥]+.*[0-9]+[.]?[0-9]*元|验证码.*[0-9]{4,8}|[0-9]+[.]?[0-9]*元.*(还款|到账|消费)|取件码.*[0-9_[:alpha:]一-龥]+|凭[0-9_[:alpha:]一-龥]+.*领取"


def counts_sql(variant: int) -> str:
    third = variant == 3
    op = count_of(OPERATOR + (" 未接来电 遇忙未接 拒接主叫 来电提醒 验证码 验证码为 安全验证 登录验证" if third else " 月卡权益"))
    amounts = AMOUNTS + ("|(支出|收入)[[:space:]]*[0-9]+[.]?[0-9]*元" if third else "")
    government = has(GOVERNMENT, "t")
    insured = [(has("投保|保单|保险|理赔|续保|车险|入账提醒", "t"), "TRANSACTION", "高", "保险/金融服务通知"), (has("车险|车辆|车牌", "t"), "TRANSACTION", "中", "车辆服务通知")]
    services = [
        (f"{government} AND NOT {has('权益|会员|流量包|优惠|红包|福利|活动', 't')}", "NEEDS_REVIEW", "高", "政府/公益/公共服务信息，无商业推广"),
        (f"{has('取件码|运单尾号|韵达|顺丰|中通|圆通|极兔|京东配送|菜鸟驿站|丰巢|妈妈驿站|派送上门' + ('|代收点' if third else ''), 't')} AND NOT {has('贷款|额度|借款|审核|权益|会员', 't')}", "TRANSACTION", "高", "快递/物流服务通知"),
        (f"{has(amounts, 't')} AND op + bank >= 2", "TRANSACTION", "高", "包含明确的交易信息（金额/账单/到账/验证码）"), ("op >= 2", "TRANSACTION", "高", "运营商服务通知（流量/余额/账单/来电提醒）") if third else ("op >= 3", "TRANSACTION", "高", "运营商服务通知（流量/余额/账单）"),
        (f"bank >= 2 AND {has(amounts, 't')}", "TRANSACTION", "高", "银行/金融交易通知"),
    ]
    cases = [
        ("trim(t) = ''", "NEEDS_REVIEW", "低", "短信内容为空"), (has("涉嫌诈骗|涉嫌恶意透支|冻结支付账户|法院传票|拘捕令|涉嫌洗钱|包裹涉毒|社保异常|逮捕令", "t"), "FRAUD", "高", "包含诈骗关键词"),
        (count_of(THREATS + " 诉前告知 移交司法 仲裁委 仲裁 催缴流程") + " >= 1", "HARASS", "高", "包含催收/威胁关键词") if third else (count_of(THREATS) + " >= 2", "HARASS", "高", "包含多个催收/威胁关键词"),
        (has("合同逾期.*全款偿还|分期资格.*取消|强制执行.*查封|催缴.*公开|联系.*亲属|提交.*仲裁|申请.*仲裁" + ("|诉前告知|最后.*还款|立即还款|拒不.*处理" if third else "|仲裁.*诉讼"), "t"), "HARASS", "高", "匹配催收模式"),
        *(insured + services if third else [*services, (has("投保|保单|保险|理赔|续保|车险", "t"), "TRANSACTION", "高", "保险服务通知")]),
        (has("施工|派单|跳纤|网元|告警|工单|检修" + ("|售后单|服务单" if third else ""), "t"), "NEEDS_REVIEW", "中", "工作/业务通知，需人工判断"), (has("今晚到明天|明晚到后天|多云|晴|气温|风力|湿度|摄氏度|度" + ("" if third else "|雨"), "t") + " AND length(t) < 200", "NEEDS_REVIEW", "高", "天气预报服务信息"),
        (f"{has('满意度|服务评价|调研|请您评价', 't')} AND {has('抽奖|赢|礼品|话费券|激励', 't')}", "AD", "中", "服务评价邀请，含营销激励（抽奖/礼品）"), (has("满意度|服务评价|调研|请您评价", "t"), "NEEDS_REVIEW", "中", "服务评价邀请，边界模糊"),
        (has("预授信|预放|预审|消费额|信用贷|预汇入|预转入|循环可支用|待激活|待提款|待提取", "t"), "AD", "高", "贷款产品推广广告"), (has("筛查|普查|补助|援助|白癜风|银屑病|胎记|癫痫|了解详情|申请检查|惠民", "t"), "AD", "中", "医疗推广信息"), (has("课程|培训|资料已发|教程已发|速领|涨分资料|剪辑推广|变现教程|学习资料", "t"), "AD", "中", "教育培训推广"),
        (f"{has('中国移动|中国联通|中国电信', 't')} AND {has('权益|会员|优惠|红包|福利|限时|免费领取|抽奖|赢取|嘉年华|礼遇', 't')}", "AD", "中", "运营商营销推广"), (f"{has('预售|上市|新品|抢购|秒杀|特惠|折扣|满减|立减|折上折', 't')} AND ads >= 2", "AD", "高", "产品营销广告"), ("ads >= 3", "AD", "高", "包含多个广告特征"),
        (government, "NEEDS_REVIEW", "高", "政府/公益信息"), ("op + bank >= 1", "TRANSACTION", "中", "疑似交易/服务通知，需人工确认"),
    ]
    said = " ".join(f"WHEN {p} THEN ['{x}', '{c}', '{why}']" for p, x, c, why in cases)
    ads = count_of(ADS + (" 立减 折上折 预售 上市 新品" if third else ""))
    return f"SELECT id, d[1] AS label, d[2] AS confidence, d[3] AS rationale, {variant} AS variant FROM (SELECT id, CASE {said} ELSE ['NEEDS_REVIEW', '低', '无法明确归类，需人工判断'] END AS d FROM (SELECT id, text AS t, {op.replace('(t,', '(text,')} AS op, {count_of(BANK).replace('(t,', '(text,')} AS bank, {ads.replace('(t,', '(text,')} AS ads FROM regional WHERE language = 'zh'))"


@query("cascade_counts_zh", f"{counts_sql(2)} UNION ALL {counts_sql(3)}", "regional")
def cascade_counts_zh(spark, d):
    packs = rows(spark, d, "zh")
    found = [packs.select("id", keyword_cascade.counts_zh(F.col("text"), v).alias("d")).select("id", "d.*", F.lit(v).alias("variant")) for v in (2, 3)]
    return found[0].unionByName(found[1])


@query("cascade_counts_zh_original", f"""
WITH v AS ({counts_sql(2)} UNION ALL {counts_sql(3)})
SELECT v.id, v.label, v.confidence, v.variant, CASE WHEN r.msg_id % 3 = 0 AND v.label IN ('TRANSACTION', 'NEEDS_REVIEW') AND {has('快递|包裹|取件|验证码|还款|账单|到账', 'r.text')} THEN '原标签为黑短信但内容为正常服务: ' || v.rationale ELSE v.rationale END AS rationale
FROM v JOIN regional r ON r.id = v.id AND r.language = 'zh'""", "regional")
def cascade_counts_zh_original(spark, d):
    """Chinese packs, a third of them labelled as bad before."""
    packs = rows(spark, d, "zh").withColumn("original", F.when(F.col("msg_id") % 3 == 0, "黑短信").when(F.col("msg_id") % 3 == 1, "广告短信"))
    found = [keyword_cascade.counts_zh_of(packs, "text", "original", "id", variant=v).withColumn("variant", F.lit(v)) for v in (2, 3)]
    return found[0].unionByName(found[1])
