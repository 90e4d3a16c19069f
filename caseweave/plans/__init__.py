"""Result tables of the study, each a composition of operators."""
