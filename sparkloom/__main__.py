from .plans.workload import main

main()
