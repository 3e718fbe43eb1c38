"""Label repair for English packs: label in, label out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.operators.cascade import cascade
from textloom.schema import NEEDS_REVIEW

# Patterns of the repair pass.
EN_ADULT = r"\b(xxx|sexy|sex\b|horny|get laid|dogging|hardcore|naked|live sex|filthyguys|picsfree|bangbabes|booty|porn|erotic)\b"
EN_ADMIRER = "secret admirer"
EN_CALLER_TUNE = r"caller\s*tune|callertune"
EN_PRIZE = (
    r"(you have won|you've won|winner!!|prize reward|claim code|to claim call|to claim txt|jackpot|bonus prize|bonus caller prize|unredeemed bonus|won a guaranteed|cash prize|awarded .{0,40}prize"
    r"|selected to receivea?\s*[£$]|selected to receive a\s*[£$]|guaranteed .{0,20}(cash|prize)|complimentary trip|account statement.{0,80}(claim|bonus|un-?redeemed))"
)
EN_PROMO = r"(ringtone|discount vouchers?|discount code|voucher holder|savamob|subscription|will be charged|free msg|freemsg|reply stop|txt stop|stop further messages|colour mobiles|mobile update)"
EN_ADULT_BRAND = "xxxmobilemovieclub|live sex video"
EN_PERSONAL = r"\b(lol|haha|love you|dinner)\b"


def repair_en(text: Column, label: Column, spam: Column, personal_ids: Column | None = None) -> Column:
    """struct(label, reason): the new label, or a null label where nothing changes.

    Personal talk leaves the classes, service results are transactions, adult and grey dating among spam is harassment unless
    it is prize fraud, prize claims are fraud, and commercial promotion that was called fraud is advertising.
    """

    def found(pattern: str) -> Column:
        return text.rlike(f"(?is){pattern}")

    prize, adult, admirer, promo = found(EN_PRIZE), found(EN_ADULT), found(EN_ADMIRER), found(EN_PROMO)
    grey = spam & (admirer | adult)
    fraud_too = grey & prize & ~admirer
    cases = [(personal_ids, NEEDS_REVIEW, "personal-chat-not-four-class")] if personal_ids is not None else []
    cases += [
        (found(EN_CALLER_TUNE) & (label != "TRANSACTION"), "TRANSACTION", "callertune-service-result"),
        (fraud_too & (label != "FRAUD"), "FRAUD", "adult-text-but-prize-fraud"),
        (grey & ~fraud_too & (label != "HARASS"), "HARASS", "adult-or-secret-admirer"),
        (found(EN_ADULT_BRAND) & (label != "HARASS"), "HARASS", "adult-brand"),
        (prize & label.isin("NEEDS_REVIEW", "AD", "HARASS"), "FRAUD", "prize-claim-fraud"),
        (~prize & (label == "FRAUD") & promo, "AD", "commercial-promo-not-fraud"),
        (~prize & ~spam & label.isin("AD", "FRAUD", "HARASS") & found(EN_PERSONAL) & ~adult & ~promo, NEEDS_REVIEW, "ham-personal-forced"),
    ]
    decided = cascade(cases, ("", ""))
    return F.struct(F.nullif(decided["label"], F.lit("")).alias("label"), decided["reason"].alias("reason"))


# Patterns of the second repair pass.
EN2_ADULT = r"\b(xxx|sexy|sex\b|horny|get laid|dogging|hardcore|naked|live sex|filthyguys|picsfree|bangbabes|booty|porn|erotic|babe|dating|blind date)\b"
EN2_PRIZE = (
    r"(you have won|you've won|u have won|winner!!|prize reward|claim code|to claim call|to claim txt|to claim,? call|jackpot|bonus prize|bonus caller prize|unredeemed bonus|won a guaranteed|cash prize|cash award"
    r"|awarded .{0,40}prize|selected to receivea?\s*[£$€]|selected to receive a\s*[£$€]|guaranteed .{0,25}(cash|prize)|complimentary (trip|4\*|holiday)|account statement.{0,80}(claim|bonus|un-?redeemed)"
    r"|won £|won \?|won \$|£\d{3,}.{0,30}(prize|award|claim)|await collection|awaiting collection|tenerife holiday|ibiza holiday|costa del sol|final notice to collect|important customer service announcement"
    r"|urgent message waiting|call freephone 0800|you have been specially selected|u have been specially selected|won the £|won the \?|£1000 prize|£900 prize|£800 prize|£2000 prize|claim yr prize)"
)
EN2_PROMO = (
    r"(ringtone|rbt|caller\s*tune|tones?\b|poly#|mono#|subscription|will be charged|unsubscribe|reply stop|txt stop|colour mobiles?|mobile update|bluetooth|double mins|orange line rental|camera phones? 4 free"
    r"|free ringtone|nokia tone|boltblue|logo 2 ur lover|half price|latest motorola|sonyericsson|quiz|txt (play|win|action|go) to|sms auction|free auction|cinema pass|camera phone upgrade|pay & go sim"
    r"|content,? games,? tones|themob>|mobstore|call germany for only|1 pence per minute|update_now|xmas offer|free bluetooth|divorce barbie|hmv bonus|hmv quiz|shopping spree|free entry into our"
    r"|weekly competition|valentine.{0,20}quiz)"
)
EN2_HARD_PRIZE = (
    r"(to claim (call|txt|your)|claim your|claim code|await collection|account statement|bonus points|un-?redeemed|£\d{3,}\s*(prize|cash|award)|won a guaranteed"
    r"|complimentary (4\*|trip|holiday).{0,40}(claim|call|await)|guaranteed £|prize guaranteed|cash await)"
)
EN2_TONE_OR_QUIZ = "(ringtone|nokia tone|sms auction|cinema pass|camera phone upgrade|hmv quiz|quiz wkly|tv quiz|txt nokia to)"
EN2_STATEMENT = "(account statement|bonus points|£900|landline)"
EN2_TONE = "(ringtone|tone|subscription|unsubscribe|mins|bluetooth)"


def repair_en_second(text: Column, label: Column, spam: Column) -> Column:
    """struct(label, reason) of the second pass: talk never has a class, promotion called fraud is advertising, and spam left
    for review is harassment, fraud or, by default, advertising."""

    def found(pattern: str) -> Column:
        return text.rlike(f"(?is){pattern}")

    hard, promo, fraud = found(EN2_HARD_PRIZE), text.rlike(f"(?id){EN2_PROMO}"), label == "FRAUD"  # a dot of promotion ends at a line feed
    left, prize = spam & (label == NEEDS_REVIEW), hard | found(EN2_PRIZE)
    decided = cascade(
        [
            (~spam & label.isin("AD", "FRAUD", "HARASS"), NEEDS_REVIEW, "ham-not-four-class"),
            (fraud & promo & ~hard, "AD", "commercial-promo-not-fraud"),
            (fraud & found(EN2_TONE_OR_QUIZ) & ~found(EN2_STATEMENT), "AD", "ringtone-quiz-auction-ad"),
            (left & (found(EN_ADMIRER) | found(EN2_ADULT) | found("xxxmobilemovieclub|live sex")), "HARASS", "spam-adult-dating"),
            (left & prize & promo & ~hard & found(EN2_TONE), "AD", "spam-review-to-ad"),
            (left & prize, "FRAUD", "spam-review-to-fraud"),
            (left & (promo | found("barbie")), "AD", "spam-review-to-ad"),
            (left, "AD", "spam-review-default-ad"),
        ],
        ("", ""),
    )
    return F.struct(F.nullif(decided["label"], F.lit("")).alias("label"), decided["reason"].alias("reason"))
