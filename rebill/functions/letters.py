"""Letters that cancel a subscription."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Services that get the English letter, and the texts of both.
FOREIGN = (
    "netflix", "spotify", "apple music", "apple tv+", "icloud+", "icloud", "youtube premium", "google one", "microsoft 365", "adobe",
    "canva", "canva pro", "figma", "notion", "telegram premium")
RUSSIAN = """Кому: Служба поддержки «{name}»
Тема: Отказ от автопродления подписки и прекращение списаний

Здравствуйте!

Я, пользователь сервиса «{name}», настоящим уведомляю об отказе от продления
подписки (услуги) с автопродлением{amount} и требую прекратить списание
денежных средств с моего банковского счёта.

В соответствии со ст. 32 Закона РФ «О защите прав потребителей» потребитель
вправе отказаться от исполнения договора об оказании услуг в любое время при
оплате фактически понесённых расходов исполнителя. В соответствии со ст. 782
ГК РФ заказчик вправе отказаться от исполнения договора возмездного оказания
услуг при условии оплаты исполнителю фактически понесённых им расходов.

Прошу:
1. Отключить автоматическое продление подписки «{name}».
2. Прекратить дальнейшие списания с моего счёта.
3. Вернуть оплату за неиспользованный период, если списание уже произведено.
4. Подтвердить отключение подписки ответным письмом в течение 10 дней
   (ст. 31 Закона РФ «О защите прав потребителей»).

Дата последнего списания: {last}
Дата обращения: {today}

С уважением,
Клиент сервиса «{name}»"""
ENGLISH = """To: {name} Support Team
Subject: Request to cancel subscription and stop recurring charges

Hello,

I am a customer of {name}. I kindly ask you to cancel my subscription and
disable auto-renewal{amount}, so that no further charges are made to
my card.

Please:
1. Cancel the subscription and auto-renewal for my account.
2. Stop all further recurring charges.
3. Refund the payment for the unused period, if one has already been charged,
   in accordance with the terms of service.
4. Confirm the cancellation by email.

Date: {today}

Best regards,
A customer of {name}"""


def letter(name: Column | str, amount: Column | str, as_of: str) -> Column:
    """The English letter for services of FOREIGN, the Russian one for all others; no sum where there is none or 0."""
    name, amount = (F.col(c) if isinstance(c, str) else c for c in (name, amount))
    number = F.replace(F.format_number(amount, 2), F.lit(","), F.lit(" "))
    some = F.coalesce(amount != 0, F.lit(False))
    today = F.date_format(F.lit(as_of).cast("date"), "dd.MM.yyyy")

    def filled(body: str, head: str, tail: str) -> Column:
        out = F.replace(F.lit(body), F.lit("{amount}"), F.when(some, F.concat(F.lit(head), number, F.lit(tail))).otherwise(""))
        for key, value in (("{last}", F.lit(as_of)), ("{today}", today), ("{name}", name)):
            out = F.replace(out, F.lit(key), value)
        return out

    return F.when(F.lower(F.trim(name)).isin(*FOREIGN), filled(ENGLISH, " (currently ", " RUB per month)")).otherwise(filled(RUSSIAN, " в размере ", " руб./мес"))
