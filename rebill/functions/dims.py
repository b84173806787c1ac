"""Lookup values of the statement analysis. All of them are fixed values that results depend on."""

# Brand, category, icon, upper-case substrings that name it; the first match in this order wins.
BRANDS = (
    ("Яндекс Плюс", "Развлечения", "🟡", ("YNDX", "YANDEX_PLUS", "YANDEX PLUS", "ЯНДЕКС.ПЛЮС", "ЯНДЕКС ПЛЮС", "ЯНДЕКС+", "YANDEX.MUSIC", "ПЛЮС МУЗЫК", "МУЗЫКА ПЛЮС")),
    ("Netflix", "Кино и видео", "🎬", ("NETFLIX", "NFLX")),
    ("Иви", "Кино и видео", "🍿", ("IVI", "ИВИ")),
    ("Кинопоиск", "Кино и видео", "🎥", ("КИНОПОИСК", "KINOPOISK", "KP*")),
    ("Okko", "Кино и видео", "🎞️", ("OKKO", "ОККО")),
    ("KION", "Кино и видео", "🎬", ("KION", "КИОН")),
    ("Premier", "Кино и видео", "📺", ("PREMIER", "ПРЕМЬЕР")),
    ("Амедиатека", "Кино и видео", "🍿", ("AMEDIATEKA", "АМЕДИАТЕКА")),
    ("More.tv", "Кино и видео", "📺", ("MORE.TV", "MORETV", "МОР ТВ")),
    ("Start", "Кино и видео", "▶️", ("START.RU", "START TV")),
    ("Wink", "Кино и видео", "📺", ("WINK", "ВИНК")),
    ("Megogo", "Кино и видео", "🎬", ("MEGOGO", "МЕГОГО")),
    ("Spotify", "Музыка", "🎧", ("SPOTIFY", "SPOT*")),
    ("Звук", "Музыка", "🎵", ("ЗВУК", "ZVUK")),
    ("Apple Music", "Музыка", "🍎", ("APPLE MUSIC", "APPLE.COM/BILLAPPLEMUSIC")),
    ("VK Музыка", "Музыка", "🎵", ("VK MUZ", "VK MUSIC", "МУЗЫКА VK", "VK.COM/MUSIC", "VK.COM", "SUBSCRIPTION VK")),
    ("YouTube Premium", "Развлечения", "▶️", ("YOUTUBE", "GOOGLE*YOUTUBE")),
    ("Telegram Premium", "Мессенджеры", "✈️", ("TG_PREMIUM", "TELEGRAM PREMIUM", "PREMIUMBOT", "T.G PREMIUM", "TEL.EGRAM")),
    ("WORLD CLASS", "Фитнес", "🏋️", ("WORLD CLASS", "WORLDCLASS", "ФИТНЕС", "WORLD CLUB")),
    ("СберПрайм", "Экосистема", "🟢", ("СБЕРПРАЙМ", "SBERPRIME", "ПРАЙМ")),
    ("Яндекс Go", "Транспорт", "🚕", ("YANDEX GO", "ЯНДЕКС ТАКСИ", "ЯНДЕКС ГО", "TAXI")),
    ("iCloud+", "Облако", "☁️", ("ICLOUD", "APPLE.COM/BILL")),
    ("Google One", "Облако", "🌐", ("GOOGLE ONE", "GOOGLE ONEAI")),
    ("Microsoft 365", "ПО", "💻", ("MICROSOFT 365", "MICROSOFT OFFICE", "OFFICE 365")),
    ("Adobe", "ПО", "🎨", ("ADOBE", "CREATIVE CLOUD")),
    ("Canva Pro", "Дизайн", "🎨", ("CANVA",)),
    ("Figma", "Дизайн", "🎨", ("FIGMA",)),
    ("Notion", "ПО", "🗂️", ("NOTION",)),
    ("Boosty", "Подписки на авторов", "🚀", ("BOOSTY",)),
    ("Ozon Premium", "Экосистема", "🔵", ("OZON PREMIUM", "ОЗОН ПРЕМИУМ")),
    ("Литрес", "Книги", "📚", ("LITRES", "ЛИТРЕС")),
    ("МТС Premium", "Экосистема", "🔴", ("MTS PREMIUM", "МТС ПРЕМИУМ")),
    ("ChatGPT", "ИИ", "🤖", ("OPENAI", "CHATGPT")),
    ("Т-Банк Pro", "Банк", "🟡", ("ТБАНК PRO", "TINKOFF PRO", "T-BANK PRO")),
    ("Обслуживание карты", "Банк", "🏦", ("ПЛАТА ЗА ОБСЛУЖИВАНИЕ", "ЗА ОБСЛУЖИВАНИЕ КАРТ", "КОМИССИЯ ЗА ОБСЛУЖИВАНИЕ", "ЕЖЕМЕСЯЧНАЯ ПЛАТА")),
)

# Abbreviations and stop words of merchant names.
ABBREVIATIONS = {"NFLX": "NETFLIX", "SPOT": "SPOTIFY", "YNDX": "YANDEX"}
STOP_WORDS = ("RU", "US", "COM", "ORG", "NET", "HTTP", "HTTPS", "WWW", "THE", "AND", "FOR", "LLC", "INC", "LTD", "GMBH")

# Cyrillic letters to Latin ones, one to one and one to several (or none).
ONE_TO_ONE = ("АБВГДЕЁЗИЙКЛМНОПРСТУФХЫЭ", "ABVGDEEZIIKLMNOPRSTUFHYE")
ONE_TO_MANY = {"Ж": "ZH", "Ц": "TS", "Ч": "CH", "Ш": "SH", "Щ": "SCH", "Ъ": "", "Ь": "", "Ю": "YU", "Я": "YA"}

# Patterns of merchants that are no subscriptions (any case).
INTERNAL = (
    "перевод|банкомат|вклад|наличн|пополнен|списание|сбербанк|стипендия|kartavklad|vklad|sberbank onl|qr[- ]?код|покупка по qr"
    "|perevod|popolnen|nalich|vnutrenn|vneshn|raspory|тбанк|т-?банк|tbank|универсальн|альфа|alfa|совком|sovcom|втб\\b|vtb|райф|raif"
    "|прочие|prochie|операци"
)
UTILITY = (
    "жкх|гис жкх|тсж|квартплат|содержан|жиль[яе]|капремонт|капрем|водоканал|водоснабж|водоотвед|теплоснабж|теплосеть|энергосбыт|энергосб[у]"
    "|газпром|межрегионгаз|горгаз|газserv|еирц|еркц|расч[её]тн|домофон|тко|обращен|вывоз|услуг|услу|uslu|uchrezd|учрежд|жилищ"
    "|домоуправл|жэу|жэк|жилсервис|госуслуг|штраф|гибдд|налог|пошлин"
)
RETAIL = (
    "пятер|pyater|красное[ &-]*белое|krasnoe|магнит|magnit|монетк|monetka|fixprice|дикси|dixy|лента|lenta|озон|ozon|wildberries|вайлдберр"
    "|аптек|apteka|aptech|starbucks|старбакс|kfc|макдоналдс|mcdonalds|cinemapark|cinema park|бургер|burger|перекрест|perekrestok"
    "|вкусно и точка|vkusnoitochka|столовая|кофейн|coffe|coffee|пицц|pizza|pitstsa|шаурма|shaurma|продукт|produkt|prodmiks"
    "|магазин|market|супермаркет|ашан|auchan|вкусвилл|vkusvill|светофор|svetofor|додо|dodo|rostics|ростикс|азс|лукойл|роснефть"
    "|gazprom neft|такси|taxi"
)
CITY_ONLY = (
    "^(?:moscow|moskva|chita|ekaterinburg|sankt|peterburg|piter|novosibirsk|kazan|city|town|rus|ru|us)"
    "(?:[\\s,]+(?:moscow|moskva|chita|ekaterinburg|sankt|peterburg|piter|rus|ru|us))*$"
)
# Statement categories and merchant category codes without subscriptions.
CATEGORIES = (
    "жкх|коммунальн|супермаркет|продукт|ресторан|кафе|фаст[- ]?фуд|транспорт|топлив|азс|такси|аптек|здоровь|красот|одежд|обувь|наличн|перевод|снятие"
    "|дом и ремонт|вс[её] для дома|автоуслуг|образован|налог|штраф"
)
CODES = (
    "4111", "4112", "4121", "4131", "4784", "4789", "3990", "4829", "6010", "6011", "6012", "6051", "4900", "5300", "5310", "5311", "5331", "5399",
    "5411", "5412", "5422", "5441", "5451", "5462", "5499", "5541", "5542", "5983", "5611", "5621", "5641", "5651", "5661", "5691", "5699",
    "5200", "5211", "5231", "5251", "5261", "5712", "5719", "5722", "5732", "5811", "5812", "5813", "5814",
    "5122", "5292", "5295", "5912", "5977", "7230", "8011", "8021", "8031", "8042", "8043", "8049", "8062", "8071", "8099",
)

# Patterns cut from a description, in this order (any case); then white space and edge marks.
STAR_CODE = "\\b([A-Z]{2,12})\\*(\\d{4})\\*([A-Z0-9. _-]{2,30})"
BANK_TAIL = "\\s*\\d{0,2}\\s*в ГУ Банка России.*$|\\s*АО\\s*«?Т[- ]?Банк»?.*$|\\s*универсальная лицензи.*$|\\s*СЧЕТ КОРРЕСПОНДЕНТА.*$|\\s*Без НДС.*$"
PAY_VERB = "^(?:оплата услуг|оплата в|оплата|платеж|платёж|покупка|списание|перевод в|payment|purchase)\\s+"
WALLET = "\\b(?:YM|WB|SBP|QR)\\*"
PHONE = "\\s*\\+?\\d[\\d ()-]{8,}\\d\\s*"
CITY_TAIL = "\\s+[A-Za-zА-Яа-яЁё?'’-]{3,20}\\s+(?:RUS|RU|US)\\b.*$|\\s+(?:RUS|RU|US)\\b.*$"
TERMINAL_TAIL = "[_.\\s]+(?:P[_ ]?QR|QR|SBP|PP[_ ]?CARD|CARD|SHOP|MARKET)\\s*$"
TERMINAL_HEAD = "^[A-Z0-9]{2,5}\\s+"  # only where these letters hold a digit
NUMBER_TAIL = "\\s+\\d{3,6}\\s*$"
EDGES = " .,·—–-"

# Where to cancel a service, and the service that already includes another.
CANCEL = {
    "Яндекс Плюс": "https://plus.yandex.ru", "Netflix": "https://www.netflix.com/CancelPlan", "Иви": "https://www.ivi.ru",
    "Telegram Premium": "https://telegram.org", "Okko": "https://okko.tv", "VK Музыка": "https://vk.com", "VK Combo": "https://vk.com",
    "KION": "https://kion.ru", "Кинопоиск": "https://kinopoisk.ru", "Spotify": "https://www.spotify.com", "iCloud+": "https://icloud.com",
    "YouTube Premium": "https://www.youtube.com", "СберПрайм": "https://www.sber.ru", "WORLD CLASS": "https://www.worldclass.ru",
    "Premier": "https://premier.one", "Амедиатека": "https://amediateka.ru", "More.tv": "https://more.tv", "Start": "https://start.ru",
    "Wink": "https://wink.ru", "Megogo": "https://megogo.ru", "Apple Music": "https://music.apple.com", "Apple TV+": "https://tv.apple.com",
    "Google One": "https://one.google.com", "Microsoft 365": "https://microsoft.com", "Adobe": "https://adobe.com",
    "Canva": "https://www.canva.com", "Figma": "https://www.figma.com", "Notion": "https://www.notion.so", "Звук": "https://zvuk.com",
}
SEARCH = "https://yandex.ru/search/?text="
SEARCH_ANY = SEARCH + "как+отменить+подписку"
INCLUDED = {"Кинопоиск": "Яндекс Плюс", "Звук": "СберПрайм", "Okko": "СберПрайм", "VK Музыка": "VK Combo", "Apple Music": "Apple One", "Apple TV+": "Apple One"}
OTHER, OTHER_ICON = "Прочее", "💳"

# Rhythm, its name in a report, least and greatest days between charges, months.
PERIODS = (
    ("monthly", "ежемесячно", 20, 40, 1), ("quarterly", "раз в 3 месяца", 80, 100, 3),
    ("semiannual", "раз в полгода", 170, 200, 6), ("annual", "ежегодно", 330, 400, 12),
)
