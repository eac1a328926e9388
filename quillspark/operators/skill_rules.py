"""Which words put a skill into which category, and which kind of work a category belongs to."""

from __future__ import annotations

# Categories in order, each with its triggers; a skill has the first category with a trigger that it holds
# or that holds it.
CATEGORIES: list[tuple[str, list[str]]] = [
    (
        "Программирование и IT",
        [
            "питон", "python", "java", "c++", "cpp", "matlab", "r", "scala", "rust", "javascript", "typescript", "go", "golang",
            "программирование", "разработка", "программист", "developer", "бэкенд", "backend", "фронтенд", "frontend", "api", "rest",
            "граф", "git", "github", "gitlab", "docker", "kubernetes", "linux", "unix", "bash", "sql", "nosql", "база данных",
        ],
    ),
    (
        "Экспериментальные методы и оборудование",
        [
            "xrd", "рентген", "sem", "tem", "afm", "спектрометр", "спектроскоп", "хроматограф", "масс-спектр", "микроскоп", "лабораторный",
            "оборудование", "прибор", "установка", "калибровка", "детектор", "сенсор", "лазерный", "вакуумный", "оптический", "измерение",
            "эксперимент", "протокол", "методика", "метод", "лаборант",
        ],
    ),
    (
        "Вычислительное моделирование",
        [
            "моделирование", "симуляция", "численный", "вычислительный", "алгоритм", "dft", "молекулярный", "динамика", "конечный элемент",
            "cfd", "hpc", "кластер", "параллельный", "gpu", "cuda", "квантовый", "расчёт", "оптимизация", "метод монте", "нейросеть",
            "нейронный", "машинный обучение", "машинный", "обучение", "искусственный интеллект", "ai", "ml", "dl",
        ],
    ),
    (
        "Анализ данных",
        [
            "статистика", "анализ данных", "регрессия", "anova", "тест", "критерий", "выборка", "распределение", "корреляция",
            "факторный анализ", "кластеризация", "визуализация", "график", "диаграмма", "база данных", "sql", "обработка", "pandas",
            "очистка", "предобработка", "парсинг",
        ],
    ),
    (
        "Научная коммуникация и публикации",
        [
            "статья", "публикация", "журнал", "рецензируемый", "обзор", "конференция", "доклад", "презентация", "отчёт", "документация",
            "грант", "заявка", "научный", "исследование", "патент", "интеллектуальный", "результат", "внедрение", "коммерциализация",
        ],
    ),
    (
        "Управление проектами и нормативы",
        [
            "управление", "руководитель", "проект", "команда", "бюджет", "план", "срок", "отчётность", "закупка", "тендер", "поставщик",
            "логистика", "риск", "качество", "сертификация", "аудит", "нормативный", "регламент", "гост", "снип", "охрана труда",
            "техника безопасности",
        ],
    ),
    (
        "Биологические и полевые методы",
        [
            "клетка", "культура", "проба", "образец", "полевой", "экспедиция", "мониторинг", "наблюдение", "вид", "популяция", "экосистема",
            "среда", "in vitro", "in vivo", "фермент", "белок", "днк", "рнк", "пцр", "секвенирование", "геном", "протеом", "метаболом",
        ],
    ),
    (
        "Химический синтез и технология",
        [
            "синтез", "реакция", "катализ", "реагент", "растворитель", "экстракция", "дистилляция", "технология", "процесс", "производство",
            "масштабирование", "пилотный", "промышленный", "сырьё", "продукт", "выход", "чистота", "контроль", "сертификат", "gmp", "glp",
        ],
    ),
    (
        "Фундаментальная физика и материаловедение",
        [
            "физика", "механика", "квантовый", "термодинамика", "электродинамика", "оптика", "фотоника", "полупроводник", "плазма",
            "ядерный", "акустика", "гидродинамика", "аэродинамика", "материал", "сплав", "полимер", "композит", "свойство", "структура",
            "фаза", "диаграмма",
        ],
    ),
]
# The kind of work of each category.
KINDS = {
    "Экспериментальные методы и оборудование": "experimental",
    "Биологические и полевые методы": "experimental",
    "Химический синтез и технология": "experimental",
    "Программирование и IT": "computational",
    "Вычислительное моделирование": "computational",
    "Анализ данных": "communication",
    "Научная коммуникация и публикации": "communication",
    "Управление проектами и нормативы": "communication",
    "Фундаментальная физика и материаловедение": "domain",
}
