"""Rows that several tests share."""

# Invented rows with spelling variants; the tests compute their values by hand from these.
PEOPLE = [
    (1, "Torsten", 31, "M", "2023-03-01"), (2, "Torsten", 64, "M", "2023-05-20"), (3, "Veronika", 27, "F", "2024-01-15"),
    (4, "Veronica", 45, "F", "2023-11-02"), (5, "Catherina", 52, "F", "2024-06-30"), (6, "Katharina", 38, "F", "2023-08-08"),
    (7, "Catharina", 29, "F", "2024-02-29"), (8, "Paula", 70, "F", "2023-01-11"), (9, "Paulo", 33, "M", "2024-04-04"),
    (10, "Rene", 41, "M", "2023-09-19"), (11, "Renate", 58, "F", "2024-03-23"), (12, "Torsten", 36, "M", "2023-03-31"),
]
