"""A cascade of pattern lists: fraud, harassment, advertising, then fall-backs for spam; each label has a cascade of reasons.

Texts are lower-cased and patterns are not: a pattern with a capital never matches. ``strict=False`` ignores case instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.schema import NEEDS_REVIEW

# Patterns and reasons, in the order in which they are tried.
FRAUD = (
    r"won.*\b(cash|prize|award|money)\b", r"\b(call|text).*\d{5,}.*(claim|won|prize|award)", r"prize.*(claim|uncollected|unredeemed)", r"(un-redeemed|unredeemed)\b.*(points|credit|SIM|S\.I\.M)",
    r"congratulations.*won", r"(guaranteed|cash|award).*call", r"selected.*(receive|award|prize)", r"urgent.*(call|won|prize|award)", r"complimentary.*call", r"(Ibiza|holiday|cash).*(await|collection|claim)",
    r"secret admirer.*call", r"REVEAL.*stop", r"(prescripiton|drvgs?|pharmacy)", r"customer service announcement.*premier", r"discount voucher.*text.*\d{5}", r"(PO Box|POBox).*\d{5,}.*(ppm|150)",
    r"(SavaMob|expressoffer|TXTAUCTION|cnupdates|getzed|ldew|smsco|comuk)", r"(posh birds|user trial|champneys)",
)
AD = (
    r"ringtone", r"(half price|new).*(camera phone|mobile|rental)", r"line rental", r"(mobiles|mobile content).*(free|direct)", r"(Nokia|Orange).*(tone|rental|upgrade)", r"(polyphonic|poly).*(tone)",
    r"txt.*(tone|music|sub).*\d{5}", r"stop.*800\d+", r"(video phone|camcorder).*free", r"(free).*(minute|text|nokia|tone|camera|roses)", r"(rental|upgrade).*call", r"(join|text).*mobile community",
    r"(text dating|gaytextbuddy|dating service)", r"(text VIP|VIP to 83)", r"(zed\s0870|1417012)", r"(anytime any network|any network mins)", r"(outbid.*|bid again|auction)", r"(Paris|flight|holiday).*(Book now|call)",
)
HARASS = (r"(horny|lapdancer|sex|live.*bedroom|text SUE|bedroom now)", r"(massage.*baby oil|fave position)", r"(inner tigress)", r"chikku.*msg", r"Kama sutra")
FRAUD_REASONS = (
    (r"(un-redeemed|unredeemed)\b.*(S\.I\.M|SIM|points|credit)", "伪造积分余额骗取个人信息"), (r"(prescripiton|drvgs?)", "假药/处方广告骗取购买"), (r"(Ibiza|holiday|cash).*(await|collection|complimentary)", "虚假假期/现金奖励骗取联系"),
    (r"(secret admirer|REVEAL)", "虚假暗恋揭秘骗取拨打电话"), (r"(posh birds|user trial|champneys)", "虚假市场调研骗取个人信息"), (r"(customer.*service.*announcement|premier)", "冒充客服虚假通知"),
    (r"(SavaMob|discount voucher|expressoffer)", "虚假优惠券骗取回复"), (r"(won|cash|prize|award|guaranteed)", "虚假中奖骗取拨打高费率电话"), (r"(urgent|message waiting)", "伪造紧急消息骗取回拨"),
    (r"text (YES|SHOP|MUSIC|TONE|START|STORE) to", "付费订阅/虚假优惠骗取回复"), (r"http.*(moby|download)", "虚假下载链接骗取点击"), (r"", "虚假信息或钓鱼骗取用户操作"),
)
AD_REASONS = (
    (r"ringtone|polyphonic|tone.*wk", "铃声/彩铃订阅收费广告"), (r"(camera phone|mobile|rental|upgrade).*(free|half price)", "手机/设备租赁促销广告"), (r"(video phone|camcorder)", "视频手机换取广告"),
    (r"(join|text).*mobile community|dating|VIP.*83", "交友/约会付费服务推广"), (r"(Nokia|Orange|Tone).*txt", "品牌促销/短信订阅服务"), (r"(zed|charity)", "慈善/铃声营销"), (r"(outbid|auction|bid)", "拍卖平台推广"),
    (r"(Paris|flight|holiday|book now)", "旅游度假促销广告"), (r"(anytime|any network mins|mins.*text.*phone)", "移动套餐促销广告"), (r"(roses|free.*event|club)", "活动/俱乐部推广"), (r"", "正规商家促销/订阅广告"),
)
HARASS_REASONS = ((r"(lapdancer|sex|text SUE|bedroom|horny)", "成人/色情骚扰短信"), (r"(massage|baby oil|kama sutra|fave position)", "性暗示骚扰内容"), (r"inner tigress", "性暗示骚扰内容"), (r"", "灰色交友/骚扰内容"))
SPAM = (
    (r"\bfree\b.*\b(call|reply|text|tone|week|entry)", "AD", "含免费优惠/订阅等营销内容"), (r"\b(text|txt)\b.*\b\d{5}\b", "AD", "通过短信订阅付费服务"), (r"\bstop\b.*\b\d{5,}\b", "AD", "含退订指令的营销短信"),
    (r"(won|won|prize|cash|award|congrat)", "FRAUD", "虚假中奖/奖品骗取联系"), (r"(urgent|important)(.|\n)*\b\d{5,}\b|\b\d{5,}\b(.|\n)*(urgent|important)", "FRAUD", "伪造紧急通知引导拨打"),
    (r"http\b.*moby|http.*download|collect.*content", "FRAUD", "虚假内容下载链接骗取点击"), (r"", NEEDS_REVIEW, "spam但无法明确归入TRANSACTION/AD/HARASS/FRAUD"),
)
TALK = "私人闲聊/个人对话"


def pattern_cascade(text: Column, spam: Column, strict: bool = True) -> Column:
    """struct(label, reason) of the first list with a matching pattern."""
    t, ignore = F.lower(text), "" if strict else "(?i)"

    def reasons(pairs: tuple[tuple[str, str], ...]) -> Column:
        out = F.lit(pairs[-1][1])
        for pattern, reason in reversed(pairs[:-1]):
            out = F.when(t.rlike(ignore + pattern), reason).otherwise(out)
        return out

    def pair(label: str, reason: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), reason.alias("reason"))

    out = None
    for patterns, label, why in ((FRAUD, "FRAUD", FRAUD_REASONS), (HARASS, "HARASS", HARASS_REASONS), (AD, "AD", AD_REASONS)):
        hit = t.rlike(ignore + "|".join(f"(?:{p})" for p in patterns))
        out = F.when(hit, pair(label, reasons(why))) if out is None else out.when(hit, pair(label, reasons(why)))
    for pattern, label, reason in SPAM:
        out = out.when(spam & t.rlike(ignore + pattern), pair(label, F.lit(reason)))
    return out.otherwise(pair(NEEDS_REVIEW, F.lit(TALK)))
