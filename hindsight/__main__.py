from .plans.job import main

main()
